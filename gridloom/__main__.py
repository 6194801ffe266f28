"""python -m gridloom key=value ...: times products of a Matrix Market file; see plans.planner.Options."""

import sys

from .plans.planner import Options, report
from .session import session, ship

if __name__ == "__main__":
    try:
        options = Options.parse(sys.argv[1:])
    except ValueError as e:
        sys.exit(f"{e}\n{Options.__doc__}")
    spark = session(options.workers, max(8, options.workers))
    ship(spark)
    print(report(spark, options))
