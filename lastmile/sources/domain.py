"""Domain tables of the two source systems, derived from the star tables.

The reports read two schemas that both have an ``order`` table, so every table carries a prefix:
``mk_*`` for the marketplace, ``lg_*`` for the logistics system. Each derivation below is a
declarative Spark plan over the star tables (the DuckDB oracle re-derives the same tables in SQL,
see ``lastmile.plans.oracle``). Money and quantities are ``decimal(18,2)`` so that sums are exact
and re-evaluation after an executor loss reproduces the same totals; timestamps stay
``timestamp_ntz`` (UTC wall clock).

Mapping (star -> domain):
  transaction, mk order, payment, lg order, provider mapping  <- orders (one row per order)
  order_fulfilment   <- lineitem grouped by (order, return flag)
  order_unit, order_line, delivery_line <- lineitem (one row per line)
  buyer store, delivery_address <- customer;  seller store, pickup_address, driver/user/fleet <- supplier
  inventory, price_tier <- lineitem grouped by (part, supplier);  product tables <- part
  delivery <- lineitem grouped by (order, supplier); ride/pickup = (supplier, month of first shipment),
  manifest number "supplier-yyyy-MM"
  address_area <- nation (city) and region (province); batch = (ride month, supplier region)
"""

from __future__ import annotations

from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lastmile.sources.star import Star

MONEY = "decimal(18,2)"
NTZ = "timestamp_ntz"

# Fixed derivation values of the fixture (FIXTURES.md §2).
TRANSACTION_DELETED_EVERY = 97  # transaction.deleted set when o_orderkey % 97 = 0
DELIVERY_DELETED_EVERY = 89  # delivery.deleted set when (l_orderkey + l_suppkey) % 89 = 0
AREA_PROVINCE_OFFSET = 1000  # province id = 1000 + r_regionkey
ONLINE_SEGMENT = "BUILDING"  # customer segment whose fee group is ONLINE
COD_PRIORITY = "1-URGENT"
DELIVERY_FEE = "1000.00"
FULFILMENT_METHODS = {"A": "PLATFORM", "N": "SELF_PICKUP", "R": "STORE_COURIER"}
FULFILMENT_STATUS = {"F": "COMPLETED", "O": "OPEN", "P": "PARTIAL"}
PAYMENT_DETAIL = {"1": "BANK_TRANSFER_A", "2": "BANK_TRANSFER_B", "3": "VIRTUAL_ACCOUNT_A", "4": None, "5": "CARD"}
DELIVERY_TAG_STATUS = {"A": "accepted", "N": "pending", "R": "returned"}
SELLER_STORES_FROM = 1_000_000_000_000  # store id of a buyer = customer key, of a seller = 1e12 + supplier key
RIDE_ID_SPAN = 1_000_000  # ride id = supplier * 1e6 + yyyymm
DELIVERY_ID_SPAN = 10_000_000  # delivery id = order * 1e7 + supplier
BATCH_ID_SPAN = 1_000  # batch id = yyyymm * 1000 + region


def _case(col: Column, mapping: dict) -> Column:
    expr = None
    for key, value in mapping.items():
        cond = col == F.lit(key)
        expr = F.when(cond, F.lit(value)) if expr is None else expr.when(cond, F.lit(value))
    return expr


def _null(type_name: str) -> Column:
    return F.lit(None).cast(type_name)


def _keep(df: DataFrame) -> DataFrame:
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def _seller_store(supplier: str) -> Column:
    return F.col(supplier) + F.lit(SELLER_STORES_FROM)


def _money(col: str | Column) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast(MONEY)


class Tables:
    """All domain tables, built lazily from one star directory.

    The grouped bases that feed several domain tables (deliveries → delivery, task, ride, route,
    batch, pick-up; supplier offers → inventory, price tier) are persisted once per ``Tables`` so a
    report that joins several of them derives each base once. In production these are stored tables.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self.star = Star(spark, sf_dir)

    # ------------------------------------------------------------------ marketplace
    @cached_property
    def mk_transaction(self) -> DataFrame:
        o = self.star.orders
        return o.select(
            F.col("o_orderkey").alias("id"),
            F.col("o_custkey").alias("buyer_store_id"),
            F.when(F.col("o_orderkey") % TRANSACTION_DELETED_EVERY == 0, F.col("o_orderdate")).alias("deleted"),
        )

    @cached_property
    def mk_order(self) -> DataFrame:
        seller = self.star.lineitem.groupBy("l_orderkey").agg(F.min("l_suppkey").alias("first_seller"))
        o = self.star.orders.select("o_orderkey", "o_orderdate")
        return o.join(seller, o.o_orderkey == seller.l_orderkey, "left").select(
            F.col("o_orderkey").alias("id"),
            F.col("o_orderkey").alias("transaction_id"),
            _seller_store("first_seller").alias("seller_store_id"),
            F.col("o_orderdate").alias("created_at"),
            _null(NTZ).alias("deleted"),
        )

    @cached_property
    def mk_order_fulfilment(self) -> DataFrame:
        f = self.star.lineitem.groupBy("l_orderkey", "l_returnflag").agg(
            F.max("l_shipdate").alias("status_updated_at")
        )
        o = self.star.orders.select("o_orderkey", "o_orderstatus")
        return f.join(o, f.l_orderkey == o.o_orderkey, "left").select(
            F.col("l_orderkey").alias("order_id"),
            _case(F.col("o_orderstatus"), FULFILMENT_STATUS).alias("status"),
            _case(F.col("l_returnflag"), FULFILMENT_METHODS).alias("delivery_method"),
            F.col("status_updated_at"),
            _null(NTZ).alias("deleted"),
        )

    @cached_property
    def mk_payment(self) -> DataFrame:
        return self.star.orders.select(
            F.col("o_orderkey").alias("transaction_id"),
            _case(F.substring("o_orderpriority", 1, 1), PAYMENT_DETAIL).cast("string").alias(
                "payment_method_detail_type"
            ),
        )

    @cached_property
    def mk_store(self) -> DataFrame:
        """All stores, those that buy and those that sell; orders and offers name both by their store id."""

        def stores(rows: DataFrame, prefix: str, store_id: Column, fee_group: Column, is_active: Column) -> DataFrame:
            return rows.select(
                store_id.alias("id"),
                F.col(f"{prefix}_name").alias("unique_id"),
                F.col(f"{prefix}_nationkey").cast("bigint").alias("address_city_id"),
                F.col(f"{prefix}_acctbal").alias("address_latitude"),
                (-F.col(f"{prefix}_acctbal")).alias("address_longitude"),
                fee_group.alias("fee_group_id"),
                is_active.alias("is_active"),
            )

        buyers = stores(self.star.customer, "c", F.col("c_custkey"), F.col("c_mktsegment"), F.lit(True))
        sellers = stores(self.star.supplier, "s", _seller_store("s_suppkey"), _null("string"), F.col("s_suppkey") % 10 != 9)
        return buyers.unionByName(sellers)

    @cached_property
    def mk_fee_group(self) -> DataFrame:
        seg = self.star.customer.select("c_mktsegment").distinct()
        return seg.select(
            F.col("c_mktsegment").alias("id"),
            F.when(F.col("c_mktsegment") == ONLINE_SEGMENT, F.lit("ONLINE"))
            .otherwise(F.col("c_mktsegment"))
            .alias("name"),
        )

    @cached_property
    def mk_address_area(self) -> DataFrame:
        city = self.star.nation.select(
            F.col("n_nationkey").cast("bigint").alias("id"),
            F.col("n_name").alias("name"),
            (F.col("n_regionkey") + AREA_PROVINCE_OFFSET).cast("bigint").alias("parent_area_id"),
        )
        province = self.star.region.select(
            (F.col("r_regionkey") + AREA_PROVINCE_OFFSET).cast("bigint").alias("id"),
            F.col("r_name").alias("name"),
            _null("bigint").alias("parent_area_id"),
        )
        return city.unionByName(province)

    @cached_property
    def mk_order_unit(self) -> DataFrame:
        li = self.star.lineitem
        qty = _money("l_quantity")
        price = _money("l_extendedprice")
        return li.select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("product_unit_id"),
            price.alias("unit_price"),
            qty.alias("ordered_quantity"),
            F.when(F.col("l_linestatus") == "F", qty).otherwise(F.lit(0).cast(MONEY)).alias("final_delivered_quantity"),
            qty.alias("final_picked_quantity"),
            F.when(F.col("l_returnflag") == "R", F.lit(1)).otherwise(F.lit(0)).cast(MONEY).alias("final_returned_quantity"),
            (price * _money("l_tax")).alias("seller_fee_amount"),
            (price * _money("l_discount")).alias("seller_fee_discount"),
        )

    @cached_property
    def mk_product_unit(self) -> DataFrame:
        return self.star.part.select(
            F.col("p_partkey").alias("id"),
            F.col("p_partkey").alias("product_variant_id"),
            F.col("p_partkey").alias("unit_of_measurement_id"),
        )

    @cached_property
    def mk_product_variant(self) -> DataFrame:
        return self.star.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))

    @cached_property
    def mk_unit_of_measurement(self) -> DataFrame:
        return self.star.part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("long_name"))

    @cached_property
    def _offer_base(self) -> DataFrame:
        g = self.star.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.min("l_extendedprice").alias("price"))
        return _keep(g.select(
            F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("id"),
            F.col("l_partkey").alias("product_unit_id"),
            _seller_store("l_suppkey").alias("store_id"),
            _money("price").alias("unit_price"),
            ((F.col("l_partkey") + F.col("l_suppkey")) % 10 != 0).alias("is_active"),
        ))

    @cached_property
    def mk_inventory(self) -> DataFrame:
        return self._offer_base.select("id", "product_unit_id", "store_id", "is_active", _null(NTZ).alias("deleted"))

    @cached_property
    def mk_price_tier(self) -> DataFrame:
        return self._offer_base.select(
            F.col("id").alias("inventory_id"), "unit_price", "is_active", _null(NTZ).alias("deleted")
        )

    # ------------------------------------------------------------------ logistics
    @cached_property
    def _delivery_base(self) -> DataFrame:
        # one exchange, by order: lines are grouped and meet their order where they lie. Few lines share a supplier
        # within an order, so nothing is lost by not combining before it. The month of the first shipment is the first month
        ship_month = F.trunc("l_shipdate", "month").alias("ship_month")
        lines = self.star.lineitem.select("l_orderkey", "l_suppkey", "l_returnflag", ship_month).repartition("l_orderkey")
        g = lines.groupBy("l_orderkey", "l_suppkey").agg(F.min("l_returnflag").alias("tag"), F.min("ship_month").alias("ship_month"))
        o = self.star.orders.select("o_orderkey", "o_orderstatus", "o_custkey", "o_orderdate")
        # supplier and nation one by one: Spark knows the size of a table, not of a join, and broadcasts small ones at once
        s = self.star.supplier.select("s_suppkey", "s_nationkey")
        n = self.star.nation.select("n_nationkey", "n_regionkey")
        base = g.join(o, g.l_orderkey == o.o_orderkey, "left").join(s, g.l_suppkey == s.s_suppkey, "left")
        base = base.join(n, base.s_nationkey == n.n_nationkey, "left")
        # only what ids and manifest numbers are made of is kept; they are made where they are read
        return _keep(base.select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_suppkey").alias("supplier"),
            F.when(F.col("o_orderstatus") == "F", F.lit("done")).otherwise(F.lit("open")).alias("status"),
            F.when((F.col("l_orderkey") + F.col("l_suppkey")) % DELIVERY_DELETED_EVERY == 0, F.col("o_orderdate")).alias(
                "deleted"
            ),
            F.col("o_custkey").alias("delivery_address_id"),
            F.col("tag").alias("delivery_tag_id"),
            F.col("ship_month"),
            F.col("n_regionkey").cast("bigint").alias("region_id"),
        ))

    # 64-bit surrogate ids: ride = (supplier, month), batch = (month, region)
    _delivery_id = property(lambda self: F.col("order_id") * DELIVERY_ID_SPAN + F.col("supplier"))
    _yyyymm = property(lambda self: (F.year("ship_month") * 100 + F.month("ship_month")).cast("bigint"))
    _ride_id = property(lambda self: F.col("supplier") * RIDE_ID_SPAN + self._yyyymm)
    _batch_id = property(lambda self: self._yyyymm * BATCH_ID_SPAN + F.col("region_id"))

    @cached_property
    def lg_delivery(self) -> DataFrame:
        return self._delivery_base.select(
            self._delivery_id.alias("id"),
            "order_id",
            "status",
            "deleted",
            F.col("supplier").alias("pickup_address_id"),
            "delivery_address_id",
            self._batch_id.alias("batch_id"),
            "delivery_tag_id",
        )

    @cached_property
    def lg_order(self) -> DataFrame:
        o = self.star.orders
        k = F.col("o_orderkey")
        return o.select(
            k.alias("id"),
            F.col("o_orderdate").alias("delivery_date"),
            F.when(F.col("o_orderpriority") == COD_PRIORITY, F.lit("COD")).otherwise(F.lit("PREPAID")).alias("payment_type"),
            F.lit(DELIVERY_FEE).cast(MONEY).alias("delivery_fee_value"),
            F.col("o_custkey").alias("delivery_address_id"),
            F.when(k % 11 == 0, F.lit(None).cast("boolean")).otherwise(k % 7 == 0).alias("is_full_truck_load"),
            F.concat(F.lit("store "), F.col("o_custkey").cast("string")).alias("store_name"),
        )

    @cached_property
    def _line_id(self) -> Column:
        return F.concat_ws(
            "-",
            F.col("l_orderkey").cast("string"),
            F.col("l_linenumber").cast("string"),
            F.col("l_partkey").cast("string"),
            F.col("l_suppkey").cast("string"),
            F.date_format("l_shipdate", "yyyyMMdd"),
        )

    def _order_lines(self, lines: DataFrame) -> DataFrame:
        return lines.select(
            self._line_id.alias("id"), F.col("l_orderkey").alias("order_id"), _money("l_extendedprice").alias("price_unit")
        )

    def _delivery_lines(self, lines: DataFrame) -> DataFrame:
        qty = _money("l_quantity")
        return lines.select(
            self._line_id.alias("order_line_id"),
            F.col("l_orderkey").alias("order_id"),
            qty.alias("quantity"),
            qty.alias("allocated_quantity"),
            F.when(F.col("l_returnflag") == "R", F.lit(0).cast(MONEY)).otherwise(qty).alias("checked_quantity"),
        )

    @cached_property
    def lg_order_line(self) -> DataFrame:
        return self._order_lines(self.star.lineitem)

    @cached_property
    def lg_delivery_line(self) -> DataFrame:
        return self._delivery_lines(self.star.lineitem)

    def lines_of(self, orders: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``lg_order_line`` and ``lg_delivery_line``, the rows of these orders (column ``order_id``), laid by order.

        Both are read from the same lines, which are shuffled once: a line's columns are one value, so both tables need
        the same exchange and Spark reuses it. Line ids are made after it, of the columns they name.
        """
        parts = ["l_linenumber", "l_partkey", "l_suppkey", F.to_date("l_shipdate").alias("l_shipdate")]
        line = F.array(F.struct(*parts, "l_extendedprice", "l_quantity", "l_returnflag")).alias("line")
        lines = self.star.lineitem.select(F.col("l_orderkey").alias("order_id"), line)
        lines = lines.join(orders, "order_id", "left_semi").repartition("order_id")
        # element_at, as a plain field or item would be cut out before the exchange
        lines = lines.select(F.element_at("line", 1).alias("line"), "order_id").select("line.*", F.col("order_id").alias("l_orderkey"))
        return self._order_lines(lines), self._delivery_lines(lines)

    @cached_property
    def _rides(self) -> DataFrame:
        rides = self._delivery_base.select("supplier", "ship_month", "region_id").distinct()
        return _keep(rides.select(
            self._ride_id.alias("ride_id"),
            F.concat_ws("-", F.col("supplier").cast("string"), F.date_format("ship_month", "yyyy-MM")).alias("manifest_no"),
            "supplier",
            "ship_month",
            self._batch_id.alias("batch_id"),
            "region_id",
        ))

    @cached_property
    def lg_ride(self) -> DataFrame:
        return self._rides.select(
            F.col("ride_id").alias("id"), F.col("ride_id").alias("route_id"), _null(NTZ).alias("deleted")
        )

    @cached_property
    def lg_route(self) -> DataFrame:
        return self._rides.select(F.col("ride_id").alias("id"), "batch_id")

    @cached_property
    def lg_batch(self) -> DataFrame:
        b = self._rides.select("batch_id", "ship_month", "region_id").distinct()
        return b.select(F.col("batch_id").alias("id"), "region_id", F.col("ship_month").alias("delivery_date"))

    @cached_property
    def lg_region(self) -> DataFrame:
        return self.star.region.select(F.col("r_regionkey").cast("bigint").alias("id"), F.col("r_name").alias("name"))

    @cached_property
    def lg_task(self) -> DataFrame:
        drop_off = self._delivery_base.select(
            self._delivery_id.alias("delivery_id"),
            self._ride_id.alias("ride_id"),
            _null("bigint").alias("pickup_id"),
            F.col("supplier").alias("driver_id"),
        )
        pick_up = self._rides.select(
            _null("bigint").alias("delivery_id"),
            "ride_id",
            F.col("ride_id").alias("pickup_id"),
            F.col("supplier").alias("driver_id"),
        )
        return drop_off.unionByName(pick_up)

    @cached_property
    def lg_pickup(self) -> DataFrame:
        return self._rides.select(
            F.col("ride_id").alias("id"), F.col("supplier").alias("pickup_address_id"), F.col("manifest_no").alias("rpb_number")
        )

    @cached_property
    def lg_pickup_address(self) -> DataFrame:
        return self.star.supplier.select(
            F.col("s_suppkey").alias("id"), F.col("s_name").alias("seller_code"), F.col("s_name").alias("name")
        )

    @cached_property
    def lg_delivery_address(self) -> DataFrame:
        c = self.star.customer.select("c_custkey", "c_name", "c_acctbal", "c_nationkey")
        n = self.star.nation.select("n_nationkey", "n_name", "n_regionkey")
        r = self.star.region.select("r_regionkey", "r_name")
        x = c.join(n, c.c_nationkey == n.n_nationkey, "left").join(r, F.col("n_regionkey") == r.r_regionkey, "left")
        return x.select(
            F.col("c_custkey").alias("id"),
            F.col("c_name").alias("buyer_code"),
            F.col("c_acctbal").alias("lat"),
            (-F.col("c_acctbal")).alias("lng"),
            F.col("n_name").alias("city"),
            F.col("r_name").alias("province"),
            F.concat(F.lit("street "), F.col("c_custkey").cast("string")).alias("line1"),
            F.col("n_name").alias("district"),
            F.col("n_name").alias("village"),
        )

    @cached_property
    def lg_driver(self) -> DataFrame:
        s = self.star.supplier
        return s.select(
            F.col("s_suppkey").alias("id"),
            F.concat(F.lit("vendor "), F.col("s_nationkey").cast("string")).alias("vendor_name"),
            F.col("s_suppkey").alias("user_id"),
            F.col("s_suppkey").alias("fleet_id"),
        )

    @cached_property
    def lg_user(self) -> DataFrame:
        return self.star.supplier.select(
            F.col("s_suppkey").alias("id"), F.concat(F.lit("driver "), F.col("s_suppkey").cast("string")).alias("name")
        )

    @cached_property
    def lg_fleet(self) -> DataFrame:
        return self.star.supplier.select(
            F.col("s_suppkey").alias("id"), F.concat(F.lit("B "), F.col("s_suppkey").cast("string")).alias("license_plate")
        )

    @cached_property
    def lg_provider_order_mappings(self) -> DataFrame:
        return self.star.orders.select(
            F.col("o_orderkey").alias("order_id"), F.concat(F.lit("E"), F.col("o_orderkey").cast("string")).alias("entity_id")
        )

    @cached_property
    def lg_delivery_tag(self) -> DataFrame:
        # tags in use, from the (persisted) delivery base rather than another lineitem scan
        flags = self._delivery_base.select("delivery_tag_id").distinct()
        return flags.select(
            F.col("delivery_tag_id").alias("id"), _case(F.col("delivery_tag_id"), DELIVERY_TAG_STATUS).alias("status")
        )


def load(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(spark, sf_dir)
