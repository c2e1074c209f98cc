import sys

from heaploom.frontend.cli import main

sys.exit(main())
