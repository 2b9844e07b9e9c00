"""The layered pipeline: setup, files to bronze, bronze to silver, silver to gold.

Dimensions are merged one batch at a time and in order, so that every version is in their history.
Facts of all pending batches are appended in one job, and gold folds all facts it has not seen
in one pass, whatever the number of versions they came in, with the dimensions as they are then;
states add up without loss (``varve.plans.marts``), so with the same dimensions results do not
depend on how runs were grouped.  Every step can be repeated after a crash: see
``varve.sources.tables``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Mapping, Sequence
from datetime import date
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from varve import schemas
from varve.functions import month_of, safe_date
from varve.operators.changes import CHANGE_TYPE, COMMITTED, POSTIMAGE, VERSION, new_images, read_changes
from varve.operators.merge import upsert
from varve.operators.scd2 import active_after, scd2_changes
from varve.plans import marts
from varve.plans.clean import clean_customers, clean_new_transactions, clean_products, valid_transactions
from varve.sources.cursors import read_cursor, seed_cursors, write_cursor
from varve.sources.feeds import FEEDS
from varve.sources.tables import (
    BATCH,
    LAYERS,
    MONTH,
    Settings,
    append_version,
    append_versions,
    create_append_table,
    create_change_table,
    create_database,
    create_sliced_table,
    create_snapshot_table,
    in_slices,
    location_of,
    partition_values,
    partition_versions,
    publish_partitions,
    publish_snapshot,
    sliced_version,
    snapshot_version,
    standing_versions,
    touched_slices,
    values_of_versions,
)
from varve.streaming.ingest import ingest

SILVER = {"customers_si": "customers_bz", "products_si": "products_bz", "transactions_si": "transactions_bz"}
CUSTOMER_SLICES, PRODUCT_SLICES = "customers_si_slices", "products_si_slices"
GOLD = ("customers_stats_gd", "sales_summary_gd", "product_sales_summary_gd")
# Facts that one task compares and writes, some 26 MB of a file.
ROWS_OF_PART = 1_000_000
_MONTHS_IN_A_LIST = 500


# Setup --------------------------------------------------------------------------------------


def run_setup(spark: SparkSession, settings: Settings) -> None:
    """Create what is missing; existing tables and cursors are left alone."""
    for layer in LAYERS:
        create_database(spark, settings.database(layer), settings.layer_path(layer))

    def at(layer: str, name: str) -> tuple[str, str]:
        return settings.table(layer, name), f"{settings.layer_path(layer)}/{name}"

    for name, ddl in (
        ("customers_bz", schemas.CUSTOMERS_BZ),
        ("products_bz", schemas.PRODUCTS_BZ),
        ("transactions_bz", schemas.TRANSACTIONS_BZ),
    ):
        table, path = at("bronze", name)
        create_append_table(spark, table, ddl, path, f"{BATCH} BIGINT")

    table, path = at("silver", "meta_si")
    create_snapshot_table(spark, table, schemas.META_SI, path)
    for name, slices, ddl, key in (
        ("customers_si", CUSTOMER_SLICES, schemas.CUSTOMERS_SI, "customer_id"),
        ("products_si_active", PRODUCT_SLICES, schemas.PRODUCTS_SI, "product_id"),
    ):
        view, path = at("silver", name)
        sliced = settings.table("silver", slices)
        create_sliced_table(spark, sliced, ddl, path, key, settings.buckets)
        spark.sql(f"CREATE OR REPLACE VIEW {view} AS SELECT {', '.join(schemas.columns(ddl))} FROM {sliced}")
    for name, ddl in (
        ("customers_si_changes", schemas.CUSTOMERS_SI),
        ("products_si_changes", schemas.PRODUCTS_SI),
    ):
        table, path = at("silver", name)
        create_change_table(spark, table, ddl, path)
    table, path = at("silver", "transactions_si")
    create_append_table(
        spark, table, f"{schemas.TRANSACTIONS_SI}, {COMMITTED} TIMESTAMP", path, f"{VERSION} BIGINT, {MONTH} STRING"
    )
    _publish_history_view(spark, settings)

    for name, ddl, key, month in (
        ("sales_summary_state", schemas.SALES_STATE, None, None),
        ("customers_stats_state", schemas.CUSTOMERS_STATE, "customer_id", None),
        ("product_sales_state", schemas.PRODUCT_STATE, None, f"{MONTH} STRING"),
    ):
        table, path = at("gold", name)
        create_snapshot_table(spark, table, ddl, path, month, key, settings.buckets)
    for name, state, shown in (
        ("sales_summary_gd", "sales_summary_state", marts.SALES_SHOWN),
        ("customers_stats_gd", "customers_stats_state", marts.CUSTOMERS_SHOWN),
        ("product_sales_summary_gd", "product_sales_state", (*marts.PRODUCTS_SHOWN, MONTH)),
    ):
        spark.sql(
            f"CREATE OR REPLACE VIEW {settings.table('gold', name)} AS "
            f"SELECT {', '.join(shown)} FROM {settings.table('gold', state)}"
        )

    seed_cursors(spark, settings.table("silver", "meta_si"), [*SILVER, *GOLD])


# Bronze -------------------------------------------------------------------------------------


def run_bronze(
    spark: SparkSession,
    settings: Settings,
    feeds: Sequence[str] = tuple(feed.name for feed in FEEDS),
    max_files: int | None = None,
) -> None:
    for feed in FEEDS:
        if feed.name in feeds:
            ingest(spark, feed, settings, max_files=max_files)


# Silver -------------------------------------------------------------------------------------


def apply_customers(
    spark: SparkSession,
    settings: Settings,
    batch: DataFrame,
    version: int,
    as_of: Column | date | None = None,
) -> None:
    """Upsert one bronze batch into the current state of customers.

    Only the slices of the batch's keys are read, and only those of changed keys are rewritten.
    """
    table, keys = settings.table("silver", CUSTOMER_SLICES), ["customer_id"]
    if sliced_version(spark, table) >= version:
        return

    def changes() -> DataFrame:
        met = in_slices(spark, table, touched_slices(spark, table, batch))
        return upsert(met, clean_customers(batch, as_of), keys, check_unique=False).changes

    written = _write_changes(spark, settings.table("silver", "customers_si_changes"), changes, version)
    # A full-outer merge keeps the buckets of the table; see apply_changes for the same by keys.
    current = in_slices(spark, table, touched_slices(spark, table, written))
    after = upsert(current, new_images(written), keys, check_unique=False).rows
    publish_snapshot(spark, table, after, version, sliced=True)


def apply_products(
    spark: SparkSession, settings: Settings, batch: DataFrame, version: int
) -> None:
    """Merge one bronze batch into the product history.

    Only active rows are rewritten, those in slices of changed keys.  Closed rows are exactly the
    post-images in the change log, so history grows by appending.
    """
    table, key = settings.table("silver", PRODUCT_SLICES), "product_id"
    if sliced_version(spark, table) < version:

        def changes() -> DataFrame:
            met = in_slices(spark, table, touched_slices(spark, table, batch))
            return scd2_changes(met, clean_products(batch), key, check_unique=False)

        written = _write_changes(spark, settings.table("silver", "products_si_changes"), changes, version)
        active = in_slices(spark, table, touched_slices(spark, table, written))
        publish_snapshot(spark, table, active_after(active, written, key), version, sliced=True)
    _publish_history_view(spark, settings)


def apply_transactions(
    spark: SparkSession,
    settings: Settings,
    batch: DataFrame,
    version: int,
    committed: Column | None = None,
) -> None:
    """Append the facts of one bronze batch that are not there yet.

    Only the keys of earlier facts in the months of this batch are read; ``batch`` must be read
    from its bronze partition for that.  ``committed`` is when the version counts as committed,
    now if not given.  A version that stands is not written again.
    """
    numbered = batch.withColumn(BATCH, F.lit(version).cast("bigint"))
    apply_transaction_batches(spark, settings, numbered, [version], committed)


def apply_transaction_batches(
    spark: SparkSession,
    settings: Settings,
    batches: DataFrame,
    versions: Sequence[int],
    committed: Column | None = None,
) -> None:
    """Append the facts of several bronze batches in one job, each as its own version.

    A fact that comes in several batches belongs to the first of them, as if they had been
    applied one by one.
    """
    table = settings.table("silver", "transactions_si")
    standing = standing_versions(spark, table, versions, MONTH)
    pending = [v for v in versions if v not in standing]
    if not pending:
        return
    first = pending[0]
    batches = batches.filter(F.col(BATCH) >= first)
    months, earlier = _batches_of_months(batches), spark.table(table).filter(F.col(VERSION) < first)
    # Months in a list are pruned by the catalog; very many of them while the query runs.
    few = len(months) <= _MONTHS_IN_A_LIST
    earlier = earlier.filter(F.col(MONTH).isin(list(months))) if few else facts_of_months(earlier, batches)
    rows_of = Counter({month: rows for month, (rows, _) in months.items()})
    rows_of.update(dict(map(tuple, earlier.groupBy(MONTH).count().collect())))
    part, parts = _parts_of_months(rows_of)
    facts = clean_new_transactions(batches, BATCH, earlier, part, parts)
    facts = facts.withColumns({
        VERSION: F.col(BATCH),
        MONTH: month_of("transaction_date"),
        COMMITTED: F.current_timestamp() if committed is None else committed,
    })
    # Where a month of many versions is cut, every part would write a file for each of them.
    spread = any(n > 2 and rows_of[month] > ROWS_OF_PART for month, (_, n) in months.items())
    sort_by = ["customer_id", "transaction_date"]
    append_versions(spark, table, facts, pending, MONTH, sort_by=sort_by, spread=spread)


def _batches_of_months(batches: DataFrame) -> dict[str, tuple[int, int]]:
    """Valid rows of ``batches`` a month, and how many batches they are of: a row for each month, collected."""
    dated = valid_transactions(batches).select(month_of("transaction_date").alias(MONTH), BATCH)
    counted = dated.groupBy(MONTH, BATCH).count().groupBy(MONTH)
    return {month: (rows, of) for month, rows, of in counted.agg(F.sum("count"), F.count("*")).collect()}


def _parts_of_months(rows_of: Mapping[str, int]) -> tuple[Column, int]:
    """The part in which a fact is compared and written, by its month and id, and the number of parts.

    A month has a part for every ``ROWS_OF_PART`` rows; small months share one.
    """
    start, parts, shared = {}, 0, 0
    for month, rows in sorted(rows_of.items()):
        shared += rows
        # Into the part before this one as long as that stays small.
        start[month] = parts - 1 if parts and shared <= ROWS_OF_PART // 16 else parts
        if start[month] == parts:
            parts += -(-rows // ROWS_OF_PART)
            shared = rows
    month, number = month_of("transaction_date"), F.lit(0)
    if start:
        first = F.create_map(*[F.lit(x) for pair in start.items() for x in pair])
        number = F.coalesce(F.element_at(first, month), number)
    cut = {m: -(-rows // ROWS_OF_PART) for m, rows in rows_of.items() if rows > ROWS_OF_PART}
    if cut:
        count = F.create_map(*[F.lit(x) for pair in cut.items() for x in pair])
        number += F.pmod(F.xxhash64("transaction_id"), F.coalesce(F.element_at(count, month), F.lit(1))).cast("int")
    return number.cast("int"), max(parts, 1)


def facts_of_months(facts: DataFrame, batch: DataFrame) -> DataFrame:
    """``facts`` in the months of ``batch``: a semi-join on the partition column, which Spark turns
    into partition pruning at run time, however many months there are."""
    months = batch.select(month_of(safe_date("transaction_date")).alias(MONTH)).distinct()
    return facts.join(months, MONTH, "left_semi")


def _write_changes(
    spark: SparkSession, table: str, changes: Callable[[], DataFrame], version: int
) -> DataFrame:
    """Write the changes and read them back: the merge join runs once and lineage ends here.

    Changes that stand are not found again: a run that was cut off later may have moved some
    slices already, and the changes give the same slices however often they are applied.
    """
    if not standing_versions(spark, table, [version], CHANGE_TYPE):
        stamped = changes().withColumn(COMMITTED, F.current_timestamp())
        append_version(spark, table, stamped, version, then_by=CHANGE_TYPE)
    return read_changes(spark, table, version - 1, version, types=None)


def _publish_history_view(spark: SparkSession, settings: Settings) -> None:
    active, sliced = settings.table("silver", "products_si_active"), settings.table("silver", PRODUCT_SLICES)
    closed = settings.table("silver", "products_si_changes")
    cols = ", ".join(schemas.columns(schemas.PRODUCTS_SI))
    spark.sql(
        f"CREATE OR REPLACE VIEW {settings.table('silver', 'products_si')} AS "
        f"SELECT {cols} FROM {active} UNION ALL SELECT {cols} FROM {closed} "
        f"WHERE {CHANGE_TYPE} = '{POSTIMAGE}' AND {VERSION} <= {sliced_version(spark, sliced)}"
    )


def _pending(spark: SparkSession, settings: Settings, name: str) -> list[int]:
    """Bronze batches that have not been applied to a silver table yet."""
    bronze = settings.table("bronze", SILVER[name])
    done = read_cursor(spark, settings.table("silver", "meta_si"), name)
    # The stream wrote through its own session.
    spark.catalog.refreshTable(bronze)
    return sorted(b for b in map(int, partition_values(spark, bronze, BATCH)) if b > done)


def _load_silver(
    spark: SparkSession,
    settings: Settings,
    name: str,
    apply: Callable[[DataFrame, int], None],
) -> list[int]:
    bronze = spark.table(settings.table("bronze", SILVER[name]))
    pending = _pending(spark, settings, name)
    for version in pending:
        apply(bronze.filter(F.col(BATCH) == version), version)
        # From the input batch, so a batch without valid rows is not read again for ever.
        write_cursor(spark, settings.table("silver", "meta_si"), name, version)
    return pending


def load_customers(
    spark: SparkSession, settings: Settings, as_of: Column | date | None = None
) -> list[int]:
    return _load_silver(
        spark, settings, "customers_si",
        lambda batch, version: apply_customers(spark, settings, batch, version, as_of),
    )


def load_products(spark: SparkSession, settings: Settings) -> list[int]:
    return _load_silver(
        spark, settings, "products_si",
        lambda batch, version: apply_products(spark, settings, batch, version),
    )


def load_transactions(spark: SparkSession, settings: Settings) -> list[int]:
    """Facts of all pending batches, in one job however many there are."""
    pending = _pending(spark, settings, "transactions_si")
    if pending:
        bronze = spark.table(settings.table("bronze", "transactions_bz"))
        batches = bronze.filter(F.col(BATCH).between(pending[0], pending[-1]))
        apply_transaction_batches(spark, settings, batches, pending)
        write_cursor(spark, settings.table("silver", "meta_si"), "transactions_si", pending[-1])
    return pending


def run_silver(spark: SparkSession, settings: Settings, as_of: Column | date | None = None) -> None:
    load_customers(spark, settings, as_of)
    load_products(spark, settings)
    load_transactions(spark, settings)


# Gold ---------------------------------------------------------------------------------------


def apply_sales_summary(spark: SparkSession, settings: Settings, since: int, until: int) -> int:
    """Fold the facts of versions in ``(since, until]`` into the sales summary; nothing is lost on the way."""
    table = settings.table("gold", "sales_summary_state")
    since = max(since, snapshot_version(spark, table))
    if since < until:
        batch = marts.sales_state(_facts(spark, settings, since, until))
        folded = marts.fold_sales(spark.table(table), batch)
        publish_snapshot(
            spark, table, folded.rows, until, sort_by=marts.SALES_KEYS, not_null=["total_transactions"]
        )
    return 0


def apply_customer_stats(
    spark: SparkSession,
    settings: Settings,
    since: int,
    until: int,
    as_of: Column | date | None = None,
) -> int:
    """Fold the facts of versions in ``(since, until]`` into the customer statistics.

    Returns how many counted facts have a customer that is not known (yet); the job that folds
    the others counts them.
    """
    table = settings.table("gold", "customers_stats_state")
    customers = spark.table(settings.table("silver", "customers_si"))
    start = max(since, snapshot_version(spark, table))
    lost = 0
    if start < until:
        totals = marts.customer_totals(_facts(spark, settings, start, until))
        marked, seen = _observed(marts.with_customer(totals, customers, "left"), "total_transactions")
        folded = marts.fold_customers(spark.table(table), marts.customer_state(marked, as_of), as_of)
        publish_snapshot(spark, table, folded.rows, until)
        lost = seen()
    if since < start:
        # Folded by a run that ended before its cursor moved, so its count is gone.
        totals = marts.customer_totals(_facts(spark, settings, since, min(start, until)))
        lost += _lost(marts.with_customer(totals, customers, "left"), "total_transactions")
    return lost


def apply_product_sales(spark: SparkSession, settings: Settings, since: int, until: int) -> int:
    """Fold the facts of versions in ``(since, until]`` into product sales, rewriting only the months they touch.

    A month that a run cut off has folded already goes on from the version its folder names.
    Returns the number of facts whose product is not known.
    """
    table = settings.table("gold", "product_sales_state")
    active = spark.table(settings.table("silver", "products_si_active"))
    touched = _touched_months(spark, settings, since, until)
    applied = {m: max(v, since) for m, v in partition_versions(spark, table, MONTH, touched).items()}
    starts: dict[int, list[str]] = {}
    for month in touched:
        starts.setdefault(applied.get(month, since), []).append(month)
    facts, lost = _facts(spark, settings, since, until), 0
    pending = [(start, months) for start, months in starts.items() if start < until]
    if pending:
        months = sorted(m for _, some in pending for m in some)
        due = reduce(lambda a, b: a | b, [F.col(MONTH).isin(some) & (F.col(VERSION) > start) for start, some in pending])
        days = marts.product_days(facts.filter(due))
        marked, seen = _observed(marts.with_product(days, active, "left"), "num_transactions")
        mart = spark.table(table).filter(F.col(MONTH).isin(months)).drop(MONTH)
        rows = marts.fold_products(mart, marts.product_state(marked)).rows
        publish_partitions(
            spark,
            table,
            rows.withColumn(MONTH, month_of("transaction_date")),
            until,
            MONTH,
            months,
            sort_by=marts.PRODUCT_KEYS[:1],
        )
        lost = seen()
    gone = [F.col(MONTH).isin(some) & (F.col(VERSION) <= start) for start, some in starts.items() if start > since]
    if gone:
        days = marts.product_days(facts.filter(reduce(lambda a, b: a | b, gone)))
        lost += _lost(marts.with_product(days, active, "left"), "num_transactions")
    return lost


def _facts(spark: SparkSession, settings: Settings, since: int, until: int) -> DataFrame:
    return read_changes(spark, settings.table("silver", "transactions_si"), since, until)


def _touched_months(spark: SparkSession, settings: Settings, since: int, until: int) -> list[str]:
    """Months of the facts of versions in ``(since, until]``, from the folders of those versions alone."""
    location = location_of(spark, settings.table("silver", "transactions_si"))
    found = values_of_versions(spark, location, range(since + 1, until + 1), MONTH)
    return sorted({month for months in found.values() for month in months})


def _lost_count(marked_column: str) -> Column:
    return F.sum(F.when(~F.col("is_known"), F.col(marked_column))).alias("lost")


def _observed(marked: DataFrame, counts: str) -> tuple[DataFrame, Callable[[], int]]:
    """``marked``, and how many facts without a known dimension row were in it once a job has used it.

    The job counts them.  A job that finds no dimension row at all leaves ``marked`` out, and with it
    the counting; only then they are counted by a job of their own.
    """
    seen = Observation()

    def lost() -> int:
        try:
            return seen.get["lost"] or 0
        except Py4JJavaError:
            return _lost(marked, counts)

    return marked.observe(seen, _lost_count(counts)), lost


def _lost(marked: DataFrame, counts: str) -> int:
    return marked.agg(_lost_count(counts)).first()["lost"] or 0


def _update_gold(
    spark: SparkSession,
    settings: Settings,
    name: str,
    apply: Callable[[int, int], int],
) -> dict[int, int]:
    meta = settings.table("silver", "meta_si")
    done, ready = read_cursor(spark, meta, name), read_cursor(spark, meta, "transactions_si")
    if ready <= done:
        return {}
    lost = {}
    # The folders know whether the versions brought any facts; if not, there is no job.
    if _touched_months(spark, settings, done, ready):
        lost[ready] = apply(done, ready)
    write_cursor(spark, meta, name, ready, sum(lost.values()))
    return lost


def update_customer_stats(
    spark: SparkSession, settings: Settings, as_of: Column | date | None = None
) -> dict[int, int]:
    return _update_gold(
        spark, settings, "customers_stats_gd",
        lambda since, until: apply_customer_stats(spark, settings, since, until, as_of),
    )


def update_sales_summary(spark: SparkSession, settings: Settings) -> dict[int, int]:
    return _update_gold(
        spark, settings, "sales_summary_gd",
        lambda since, until: apply_sales_summary(spark, settings, since, until),
    )


def update_product_sales(spark: SparkSession, settings: Settings) -> dict[int, int]:
    return _update_gold(
        spark, settings, "product_sales_summary_gd",
        lambda since, until: apply_product_sales(spark, settings, since, until),
    )


def run_gold(
    spark: SparkSession, settings: Settings, as_of: Column | date | None = None
) -> dict[str, dict[int, int]]:
    """Bring all marts up to date; per mart, the last version folded and the facts lost to unknown keys."""
    return {
        "customers_stats_gd": update_customer_stats(spark, settings, as_of),
        "sales_summary_gd": update_sales_summary(spark, settings),
        "product_sales_summary_gd": update_product_sales(spark, settings),
    }
