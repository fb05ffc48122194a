import sys

from lodeworks.cli import main

sys.exit(main())
