import sys

from tessel.cli import main

sys.exit(main())
