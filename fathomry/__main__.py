import sys

from fathomry.cli import main

sys.exit(main())
