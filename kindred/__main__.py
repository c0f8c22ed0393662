import sys

from kindred.runner import main

sys.exit(main())
