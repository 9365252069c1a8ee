import sys

from codeweft.commands import main

sys.exit(main())
