"""spark-submit entry point, see ``clickfold.plans.jobs``."""

import sys

from clickfold.plans.jobs import main

if __name__ == "__main__":
    sys.exit(main())
