import sys

from polyglint.console import main

sys.exit(main())
