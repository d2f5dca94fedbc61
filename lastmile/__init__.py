"""lastmile — marketplace and own-fleet delivery analytics as Spark DataFrame plans.

Layout:
  sources/    star-schema parquet -> marketplace (mk_*) and logistics (lg_*) domain tables
  functions/  Column -> Column business expressions (channel, payment family, COD fee, local month, ...)
  operators/  DataFrame -> DataFrame building blocks (cohorts, order GMV, delivery fact, deciles, offers)
  plans/      the reports composed from operators, the query catalog and the DuckDB oracle twins
  streaming/  the same operators applied to streaming DataFrames
"""

from lastmile.session import get_session

__all__ = ["get_session"]
