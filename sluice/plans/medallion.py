"""The medallion over the four raw tables as lazy frames, built once per instance."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

from pyspark.sql import DataFrame

from sluice.operators import classify, gold
from sluice.operators.refresh import refresh
from sluice.schemas import ENTITIES
from sluice.sources.layers import LayerStore

RUN_TS = "2024-06-01 00:00:00"

LAYERS = (
    *[f"bronze_{e}" for e in ("customers", "products", "orders", "payments")],
    *[f"silver_{e}" for e in ("customers", "products", "orders", "payments")],
    *[f"silver_{e}_rejects" for e in ("customers", "products", "orders", "payments")],
    "gold_orders_obt",
    "gold_revenue_daily",
)


class Medallion(Mapping[str, DataFrame]):
    """Table name to frame. Accepted and rejected rows come from one classification.

    ``raw`` gives the raw table of an entity. ``keep`` writes a table out and returns it
    as read back; it is used where several consumers follow, so that a classification
    is computed once. Without it everything stays one lazy plan.
    """

    def __init__(
        self,
        raw: Callable[[str], DataFrame],
        run_ts: str = RUN_TS,
        keep: Callable[[str, DataFrame], DataFrame] | None = None,
    ):
        self.raw = raw
        self.run_ts = run_ts
        self._keep = keep
        self._kept: set[str] = set()

    def bronze(self, entity: str) -> DataFrame:
        return classify.bronze(self.raw(entity), entity)

    @cached_property
    def _classified(self) -> dict[str, DataFrame]:
        return {}

    def classified(self, entity: str) -> DataFrame:
        if entity not in self._classified:
            bronze = self.bronze(entity)
            if entity == "payments":
                self.share("orders")
                frame = classify.classify_payments(bronze, self.silver("orders"))
            else:
                frame = getattr(classify, f"classify_{entity}")(bronze)
            self._classified[entity] = frame
        return self._classified[entity]

    def put_classified(self, entity: str, written: DataFrame) -> None:
        """Use a written classification from here on."""
        self._classified[entity] = written
        self._kept.add(entity)

    def share(self, *entities: str) -> Medallion:
        """Write out classified entities that are about to be used more than once."""
        for entity in entities:
            if self._keep is not None and entity not in self._kept:
                frame = self.classified(entity)
                self.put_classified(entity, self._keep(f"classified_{entity}", frame))
        return self

    def share_gold(self) -> Medallion:
        if self._keep is not None and "gold" not in self._kept:
            self.__dict__["obt"] = self._keep("gold_orders_obt", self.obt)
            self._kept.add("gold")
        return self

    def silver(self, entity: str) -> DataFrame:
        return classify.accepted(self.classified(entity), entity)

    def rejects(self, entity: str) -> DataFrame:
        return classify.rejects(self.classified(entity), self.run_ts)

    @cached_property
    def obt(self) -> DataFrame:
        payments = self.silver("payments")
        return gold.orders_obt(
            self.silver("orders"), self.silver("customers"), self.silver("products"), payments
        )

    @cached_property
    def daily(self) -> DataFrame:
        return gold.revenue_daily(self.obt)

    def __getitem__(self, table: str) -> DataFrame:
        if table not in LAYERS:
            raise KeyError(table)
        if table == "gold_orders_obt":
            return self.obt
        if table == "gold_revenue_daily":
            return self.daily
        layer, entity = table.split("_", 1)
        if layer == "bronze":
            return self.bronze(entity)
        if entity.endswith("_rejects"):
            return self.rejects(entity.removesuffix("_rejects"))
        return self.silver(entity)

    def __iter__(self) -> Iterator[str]:
        return iter(LAYERS)

    def __len__(self) -> int:
        return len(LAYERS)


def publish(tables: Medallion, store: LayerStore, mode: str = "full") -> dict[str, DataFrame]:
    """Write all layers and make them visible with one commit.

    Bronze stays a view. Each classification is written once; silver and rejects are
    read from it, gold from the written silver. With ``mode="strict"`` or
    ``"reference"`` the last committed silver tables are refreshed, else rebuilt.
    Independent tables are written at the same time; payments wait for orders.
    """
    last = store.version()
    out: dict[str, DataFrame] = {}

    def classified(entity: str) -> None:
        store.view("bronze", entity, tables.bronze(entity))
        verdicts = store.overwrite("classified", entity, tables.classified(entity), last + 1)
        tables.put_classified(entity, verdicts)

    def halves(entity: str) -> None:
        silver = tables.silver(entity)
        if mode != "full" and last:
            before = store.read("silver", entity)
            verdicts = tables.classified(entity)
            silver = refresh(before, verdicts, entity, ENTITIES[entity].pk, mode)
        rejected = f"{entity}_rejects"
        out[f"silver_{entity}"] = store.overwrite("silver", entity, silver, last + 1)
        out[f"silver_{rejected}"] = store.overwrite(
            "silver", rejected, tables.rejects(entity), last + 1
        )

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(classified, ("customers", "products", "orders")))
        early = pool.map(halves, ("customers", "products", "orders"))
        classified("payments")
        halves("payments")
        list(early)
    silver = [out[f"silver_{e}"] for e in ("orders", "customers", "products", "payments")]
    obt = store.overwrite("gold", "orders_obt", gold.orders_obt(*silver), last + 1)
    out["gold_orders_obt"] = obt
    daily = gold.revenue_daily(obt)
    out["gold_revenue_daily"] = store.overwrite("gold", "revenue_daily", daily, last + 1)
    store.commit(last + 1)
    return out
