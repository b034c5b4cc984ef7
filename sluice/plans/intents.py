"""Named analytical questions over the gold tables, and the reports built from them."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.functions.expressions import realised, sort_columns
from sluice.operators.audit import stack

DEFAULT_LIMIT = 100
MAX_LIMIT = 1000

Gold = Mapping[str, DataFrame]


class IntentError(ValueError):
    """An unknown name, or a value outside what an intent allows."""


def _iso_date(name: str, value: object) -> Column:
    try:
        return F.lit(date.fromisoformat(str(value)))
    except ValueError as exc:
        raise IntentError(f"{name} must be an ISO date, got {value!r}") from exc


def _from_day(col: Callable[[], Column]) -> Callable[[object], Column]:
    return lambda v: col() >= _iso_date("start_date", v)


def _to_day(col: Callable[[], Column]) -> Callable[[object], Column]:
    return lambda v: col() <= _iso_date("end_date", v)


def _order_date() -> Column:
    return F.col("order_date")


def _ordered_day() -> Column:
    return F.to_date("ordered_at")


def _category(value: object) -> Column:
    return F.col("product_category") == F.lit(str(value))


@dataclass(frozen=True)
class Intent:
    """A fixed aggregation over one gold table with optional filters."""

    title: str
    table: str
    keys: tuple[str, ...]
    measures: Callable[[], list[Column]]
    filters: dict[str, Callable[[object], Column]] = field(default_factory=dict)
    sortable: tuple[str, ...] = ()
    default_order: str = ""


def _rollup_sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in ("order_count", "units_sold", "gross_revenue")]


def _country_measures() -> list[Column]:
    return [F.count("*").alias("order_count"), F.sum(realised()).alias("gross_revenue")]


def _product_measures() -> list[Column]:
    return [
        F.count("*").alias("order_count"),
        F.sum("quantity").alias("units_sold"),
        F.sum(realised()).alias("gross_revenue"),
    ]


def _status_measures() -> list[Column]:
    return [
        F.count("*").alias("order_count"),
        F.sum("total_amount").alias("total_amount"),
        F.count_if("is_late").alias("late_count"),
    ]


DAILY_WINDOW = {"start_date": _from_day(_order_date), "end_date": _to_day(_order_date)}
ORDER_WINDOW = {"start_date": _from_day(_ordered_day), "end_date": _to_day(_ordered_day)}

INTENTS: dict[str, Intent] = {
    "revenue_by_period": Intent(
        "Revenue per day",
        "gold_revenue_daily",
        ("order_date",),
        _rollup_sums,
        {**DAILY_WINDOW, "category": _category},
        ("order_date", "gross_revenue", "order_count", "units_sold"),
        "order_date desc",
    ),
    "revenue_by_category": Intent(
        "Revenue per product category",
        "gold_revenue_daily",
        ("product_category",),
        _rollup_sums,
        DAILY_WINDOW,
        ("product_category", "gross_revenue", "order_count", "units_sold"),
        "gross_revenue desc",
    ),
    "revenue_by_country": Intent(
        "Realised revenue per customer country",
        "gold_orders_obt",
        ("customer_country",),
        _country_measures,
        ORDER_WINDOW,
        ("customer_country", "gross_revenue", "order_count"),
        "gross_revenue desc",
    ),
    "top_products": Intent(
        "Products by realised revenue",
        "gold_orders_obt",
        ("product_sku", "product_name", "product_category"),
        _product_measures,
        {"category": _category},
        ("gross_revenue", "units_sold", "order_count", "product_name"),
        "gross_revenue desc",
    ),
    "order_status_breakdown": Intent(
        "Orders per status",
        "gold_orders_obt",
        ("status",),
        _status_measures,
        {},
        ("order_count", "total_amount", "status"),
        "order_count desc",
    ),
}


def clamp_limit(limit: object) -> int:
    """Default 100, at most 1000, positive whole numbers only."""
    if limit is None:
        return DEFAULT_LIMIT
    whole = isinstance(limit, int) and not isinstance(limit, bool)
    if not whole and not (isinstance(limit, str) and limit.strip().isdecimal()):
        raise IntentError(f"limit must be a whole number, got {limit!r}")
    n = int(limit)
    if n < 1:
        raise IntentError("limit must be at least 1")
    return min(n, MAX_LIMIT)


def sort_order(intent: Intent, order_by: str | None) -> list[tuple[str, bool]]:
    """(column, descending) pairs: the requested column, then the keys as tie-breakers."""
    words = (order_by or intent.default_order).split()
    if not words or len(words) > 2:
        raise IntentError(f"cannot read the order {order_by!r}")
    column, direction = words[0], (words[1].lower() if len(words) == 2 else "asc")
    if column not in intent.sortable:
        raise IntentError(f"cannot order by {column!r}; one of {', '.join(intent.sortable)}")
    if direction not in ("asc", "desc"):
        raise IntentError(f"direction must be asc or desc, not {direction!r}")
    ties = [(key, False) for key in intent.keys if key != column]
    return [(column, direction == "desc"), *ties]


def intent_frame(
    gold: Gold,
    name: str,
    params: Mapping[str, object] | None = None,
    order_by: str | None = None,
) -> DataFrame:
    """The whole answer to one named question. An absent or NULL parameter is no filter."""
    if name not in INTENTS:
        raise IntentError(f"unknown intent {name!r}; one of {', '.join(INTENTS)}")
    intent = INTENTS[name]
    unknown = set(params or {}) - set(intent.filters)
    if unknown:
        raise IntentError(f"unknown parameters for {name}: {', '.join(sorted(unknown))}")
    order = sort_order(intent, order_by)
    df = gold[intent.table]
    for param, value in (params or {}).items():
        if value is not None:
            df = df.where(intent.filters[param](value))
    answer = df.groupBy(*intent.keys).agg(*intent.measures())
    return answer.orderBy(*sort_columns(order))


def run_intent(
    gold: Gold,
    name: str,
    params: Mapping[str, object] | None = None,
    limit: object = None,
    order_by: str | None = None,
) -> DataFrame:
    """The answer to one named question as it is served: at most ``limit`` rows."""
    rows = clamp_limit(limit)
    return intent_frame(gold, name, params, order_by).limit(rows)


@dataclass(frozen=True)
class Section:
    key: str
    intent: str
    limit: int
    params: dict[str, object] = field(default_factory=dict)


REPORTS: dict[str, tuple[Section, ...]] = {
    "executive_summary": (
        Section("by_category", "revenue_by_category", 20),
        Section("by_country", "revenue_by_country", 20),
        Section("top_products", "top_products", 10),
        Section("status_mix", "order_status_breakdown", 20),
    ),
    "daily_revenue": (
        Section("trend", "revenue_by_period", 60),
        Section("category_split", "revenue_by_category", 20),
    ),
}


def run_report(
    gold: Gold, name: str, params: Mapping[str, object] | None = None
) -> dict[str, DataFrame]:
    """The sections of a report. A section gets only the parameters its intent declares."""
    if name not in REPORTS:
        raise IntentError(f"unknown report {name!r}; one of {', '.join(REPORTS)}")
    sections = {}
    for section in REPORTS[name]:
        declared = INTENTS[section.intent].filters
        shared = {k: v for k, v in (params or {}).items() if k in declared}
        sections[section.key] = run_intent(
            gold, section.intent, {**section.params, **shared}, section.limit
        )
    return sections


def report_rows(
    gold: Gold, name: str, params: Mapping[str, object] | None = None
) -> DataFrame:
    """A report as one frame: section, rank, label, order count and amount.

    All sections on one gold table are grouping sets of one aggregation, so a table is
    scanned and shuffled once however many sections it feeds.
    """
    if name not in REPORTS:
        raise IntentError(f"unknown report {name!r}; one of {', '.join(REPORTS)}")
    by_table: dict[str, list[Section]] = {}
    for section in REPORTS[name]:
        by_table.setdefault(INTENTS[section.intent].table, []).append(section)
    return stack([_grouped_sections(gold[t], part, params or {}) for t, part in by_table.items()])


def _grouped_sections(
    table: DataFrame, sections: Sequence[Section], params: Mapping[str, object]
) -> DataFrame:
    """Sections over one table. A set holds a section's keys and whether its filters pass."""
    copies, sets, measures = {}, [], []
    order, labels, counts, amounts = [], [], [], []
    for s in sections:
        intent = INTENTS[s.intent]
        shared = {k: v for k, v in params.items() if k in intent.filters}
        passes = F.lit(True)
        for param, value in {**s.params, **shared}.items():
            if value is not None:
                passes = passes & intent.filters[param](value)
        own = {f"_in_{s.key}": F.coalesce(passes, F.lit(False))}
        own |= {f"_{s.key}_{k}": F.col(k) for k in intent.keys}
        copies |= own
        sets.append(list(own))
        names = table.groupBy().agg(*intent.measures()).columns
        measures += [m.alias(f"_{s.key}_{n}") for m, n in zip(intent.measures(), names, strict=True)]
        measures.append(F.grouping(f"_in_{s.key}").alias(f"_out_{s.key}"))

        here = F.col("section") == s.key
        for column, descending in sort_order(intent, None):
            spot = F.when(here, F.col(f"_{s.key}_{column}"))
            order.append(spot.desc_nulls_last() if descending else spot.asc_nulls_last())
        amount = "total_amount" if s.intent == "order_status_breakdown" else "gross_revenue"
        label = F.concat_ws(" / ", *[F.col(f"_{s.key}_{k}").cast("string") for k in intent.keys])
        labels.append(F.when(here, label))
        counts.append(F.when(here, F.col(f"_{s.key}_order_count")))
        amounts.append(F.when(here, F.col(f"_{s.key}_{amount}").cast("decimal(38,2)")))

    any_passes = reduce(or_, [copies[f"_in_{s.key}"] for s in sections])
    grouped = table.where(any_passes).withColumns(copies).groupingSets(sets, *copies).agg(*measures)
    section = F.coalesce(
        *[F.when((F.col(f"_out_{s.key}") == 0) & F.col(f"_in_{s.key}"), s.key) for s in sections]
    )
    # Tasks keep no more groups of a section than the longest section shows.
    ranked = grouped.withColumn("section", section).where(F.col("section").isNotNull()).withColumn(
        "rank", F.row_number().over(Window.partitionBy("section").orderBy(*order))
    )
    limit = F.coalesce(*[F.when(F.col("section") == s.key, s.limit) for s in sections])
    shown = ranked.where(F.col("rank") <= max(s.limit for s in sections)).where(F.col("rank") <= limit)
    return shown.select(
        "section",
        "rank",
        F.coalesce(*labels).alias("label"),
        F.coalesce(*counts).alias("order_count"),
        F.coalesce(*amounts).alias("amount"),
    )


EXPOSED_TABLES = ("gold_orders_obt", "gold_revenue_daily")

COUNTABLE_TABLES = (
    "silver_orders",
    "silver_orders_rejects",
    "silver_payments",
    "silver_payments_rejects",
    "silver_customers",
    "silver_customers_rejects",
    "silver_products",
    "silver_products_rejects",
    "gold_orders_obt",
    "gold_revenue_daily",
)


def schema_info(gold: Gold, table: str | None = None) -> DataFrame:
    """Exposed tables with their columns, types and row counts.

    A table that has not been built is one row without columns and count.
    """
    if table is not None and table not in EXPOSED_TABLES:
        raise IntentError(f"table {table!r} is not exposed; one of {', '.join(EXPOSED_TABLES)}")
    parts, unbuilt = [], []
    for name in EXPOSED_TABLES if table is None else (table,):
        df = gold.get(name)
        if df is None:
            unbuilt.append(name)
            continue
        columns = [
            F.struct(
                F.lit(i).alias("position"),
                F.lit(f.name).alias("column_name"),
                F.lit(f.dataType.simpleString()).alias("type"),
            )
            for i, f in enumerate(df.schema.fields, 1)
        ]
        counted = df.agg(F.count("*").alias("row_count"))
        parts.append(
            counted.select(
                F.lit(name).alias("table_name"),
                F.lit(True).alias("materialised"),
                "row_count",
                F.explode(F.array(*columns)).alias("c"),
            ).select("table_name", "materialised", "row_count", "c.*")
        )
    if unbuilt:
        ddl = (
            "table_name STRING, materialised BOOLEAN, row_count BIGINT, position INT, column_name STRING, type STRING"
        )
        spark = SparkSession.active()
        parts.append(spark.createDataFrame([(n, False, None, None, None, None) for n in unbuilt], ddl))
    return stack(parts)


def catalogue(gold: Gold) -> DataFrame:
    """Everything that may be asked: tables with their number of columns, intents with
    their number of sort columns, reports with their number of sections."""
    tables = schema_info(gold).groupBy("table_name", "materialised", "row_count").agg(
        F.count("column_name").cast("int").alias("entries")
    )
    rows = [("intent", name, None, None, len(i.sortable)) for name, i in INTENTS.items()]
    rows += [("report", name, None, None, len(sections)) for name, sections in REPORTS.items()]
    ddl = "kind STRING, name STRING, materialised BOOLEAN, row_count BIGINT, entries INT"
    asked = SparkSession.active().createDataFrame(rows, ddl)
    return tables.select(
        F.lit("table").alias("kind"), F.col("table_name").alias("name"), "materialised", "row_count", "entries"
    ).unionByName(asked)


def intent_info(any_frame: DataFrame) -> DataFrame:
    """The intents and reports with their parameters and sort columns."""
    rows = [
        ("intent", name, i.title, ",".join(i.filters), ",".join(i.sortable), i.default_order)
        for name, i in INTENTS.items()
    ]
    rows += [
        ("report", name, "", "", ",".join(s.key for s in sections), "")
        for name, sections in REPORTS.items()
    ]
    ddl = "kind STRING, name STRING, title STRING, params STRING, columns STRING, default_order STRING"
    return any_frame.sparkSession.createDataFrame(rows, ddl)


def table_counts(tables: Mapping[str, DataFrame], names: tuple[str, ...] = COUNTABLE_TABLES) -> DataFrame:
    """Row counts of allow-listed tables."""
    for name in names:
        if name not in COUNTABLE_TABLES:
            raise IntentError(f"table {name!r} may not be counted")
    return stack(
        [
            tables[name].agg(F.lit(name).alias("table_name"), F.count("*").alias("rows"))
            for name in names
        ]
    )
