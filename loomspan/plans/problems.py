"""Queries of the general data problems (2, 5 and 7)."""

from loomspan.operators import intervals, references, timestamps
from loomspan.plans import times_sql

QUERIES = {
    "p2_found": references.p2_found,
    "p2_report": references.p2_report,
    "p5_found": intervals.p5_found,
    "p5_periods": intervals.p5_periods,
    "p7_found": timestamps.p7_found,
}
ORACLES = {
    "p2_found": references.P2_FOUND_SQL,
    "p2_report": references.P2_REPORT_SQL,
    "p5_found": times_sql.P5_FOUND_SQL,
    "p5_periods": times_sql.P5_PERIODS_SQL,
    "p7_found": times_sql.P7_FOUND_SQL,
}
