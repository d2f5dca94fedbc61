"""Report parameters used on the star fixture (FIXTURES.md §2, "Suggested parameters").

The reports take them as keyword arguments; these are the values the query catalog, the bench and
the oracle use. Each is a report parameter (month of adoption, order date window, value cap), not a
sample of the data: the queries read whole tables.
"""

ADOPTION_FROM = "1997-01"  # adopter cohort: status change month >= this
ADOPTION_TO = "1998-01"  # ... and < this (bounded cohorts)
# open-ended cohorts (R3, R4) start at the reporting month, near the end of the data, as in the
# original reports; from 1997-01 they would hold 86% of buyers and leave no non-adopter lead
OPEN_ADOPTION_FROM = "2001-06"
ORDERS_AFTER = "19960101"  # order created_at > this (exclusive)
ORDERS_BEFORE = "20000101"  # order created_at < this (exclusive)
VALUE_CAP = 15_000_000  # order value cap
DELIVERIES_AFTER = "19960101"  # batch delivery date > this
HAVING_MIN_GMV = 10  # province summary: adopters above threshold > this (GMV report)
HAVING_MIN_ORDERS = 2  # same for the order-count report (10 leaves no province at sf0.01)
MANIFEST_SEARCH = "-1997-0"  # manifest number contains this text (case-insensitive)
SELECTED_BUYERS = [f"Customer#{n:09d}" for n in (7, 61, 100)]  # narrow form of R8; the first one for R6
SELECTED_SELLERS = [f"Supplier#{n:09d}" for n in range(1, 17)]  # narrow form of R6
SELECTED_LEAD = "Customer#000000006"  # narrow form of R4
