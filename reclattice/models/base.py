"""What all three models share: the encoded, summed interaction table."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from reclattice.operators.encode import OrdinalEncoder
from reclattice.operators.filters import binarize_rating
from reclattice.operators.matrix import gram, user_item
from reclattice.session import checkpointed

# Threshold the models binarize at.
BINARIZE_ABOVE = 3.5


@dataclass
class Interactions:
    """Cells ``(u, i, v)``: u is the user id as given, i the dense item index. They are partitioned by
    user and sorted by user and item, and operators walk them as they lie."""

    cells: DataFrame
    items: OrdinalEncoder
    user: str
    item: str
    n_cells: int
    gram_table: DataFrame | None = None
    spectrum: DataFrame | None = None
    path: list | None = None
    sides: dict | None = None
    held: list[DataFrame] = field(default_factory=list)

    @property
    def n_items(self) -> int:
        return self.items.size

    @cached_property
    def n_users(self) -> int:
        return self.cells.select("u").distinct().count()

    @cached_property
    def lowest(self) -> float:
        return self.cells.agg(F.min("v")).first()[0]

    @property
    def gram(self) -> DataFrame:
        """Upper triangle of X'X, made once and shared by every grid point."""
        if self.gram_table is None:
            self.gram_table = self.hold(gram(self.cells, self.n_items, by_user=True))
        return self.gram_table

    def hold(self, df: DataFrame) -> DataFrame:
        """Persist a table derived from the cells until ``release``."""
        self.held.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return self.held[-1]

    def decoded(self, top: DataFrame) -> DataFrame:
        """``(scores, user, item, rank)`` with the original ids, from ``(u, i, scores, rank)``."""
        named = top.select("scores", F.col("u").alias(self.user), F.col("i").alias(self.item), "rank")
        return self.items.inverse_transform(named).select("scores", self.user, self.item, "rank")

    def release(self) -> None:
        for df in [self.cells, *self.held]:
            df.unpersist()
        for side in (self.sides or {}).values():
            side.release()
        self.held.clear()
        self.gram_table = self.spectrum = self.path = self.sides = None


def laid_out(cells: DataFrame) -> DataFrame:
    """Whole users in one partition, in a row, by item. A user has at most one cell per item."""
    return cells.repartition("u").sortWithinPartitions("u", "i")


def prepare(df: DataFrame, user: str, item: str, rating: str, binarize: bool) -> Interactions:
    """Binarize, add up repeated pairs, encode items, and lay the cells out by user.

    Users need no index of their own: no operator addresses them by position. Summing
    comes before the partitioning, so a user with many repeated rows shrinks to at most
    one cell per item before any shuffle on the user. The source is read once.
    """
    if binarize:
        df = binarize_rating(df, rating, BINARIZE_ABOVE)
    summed = (
        user_item(df, user, item, rating)
        .withColumnRenamed("i", item)
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    encoder = OrdinalEncoder(item).fit(summed)
    # Read many times: the checkpoint keeps a lost executor, and every later plan, off the source.
    encoded = encoder.transform(summed).select("u", F.col(item).alias("i"), "v")
    cells = checkpointed(laid_out(encoded)).persist(StorageLevel.MEMORY_AND_DISK)
    data = Interactions(cells, encoder, user, item, cells.count())
    summed.unpersist()
    return data
