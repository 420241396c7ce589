"""A system matrix on disk, bucketed so that projections join it without an exchange.

Exact path lengths of all lines are computed once and written twice: bucketed by voxel,
as forward projection meets the image, and by line, as back projection meets the
lines' ratios. Both projections scan their table bucket by bucket; what is shuffled
are the image or the ratios, and partial sums. The matrix is never in memory as a whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumivox.jobs.reconstruction import update
from lumivox.lineage import cut, new_folder


class StoredMatrix:
    """Rows (lor_id, vox, w); ``buckets`` is that of shuffles unless given."""

    def __init__(self, rays: DataFrame, buckets: int | None = None):
        self.spark = rays.sparkSession
        self.buckets = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.name, folder = f"matrix_{uuid.uuid4().hex}", new_folder(self.spark, "matrix")
        self.folder = folder
        self._write(rays, "vox")
        self._write(self.spark.read.schema(rays.schema).parquet(f"{folder}/vox"), "lor_id")

    def _write(self, rays: DataFrame, key: str) -> None:
        ordered = rays.select("lor_id", "vox", "w").repartition(self.buckets, key)
        ordered.write.format("parquet").bucketBy(self.buckets, key).sortBy(key).option("path", f"{self.folder}/{key}").saveAsTable(f"{self.name}_{key}")

    def by(self, key: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{key}")

    def met(self, key: str, rows: DataFrame) -> DataFrame:
        """The matrix joined with rows by their key; these are dealt into its buckets, or Spark might deal out the matrix anew to match them."""
        return self.by(key).join(rows.repartition(self.buckets, key), key)

    def drop(self) -> None:
        """Forget the tables; their files stay in the shared folder."""
        for key in ("vox", "lor_id"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{key}")

    def forward(self, image: DataFrame, mu: DataFrame | None = None, scale: float = 0.5) -> DataFrame:
        """(lor_id, q) of an image (vox, v), attenuated by exp(-scale * sum of w * mu) if a map (vox, mu) is given; zeros are dropped."""
        q: Column = F.sum(F.col("w") * F.col("v"))
        if mu is not None:
            image, q = image.join(mu, "vox"), q * F.exp(-scale * F.sum(F.col("w") * F.col("mu")))
        return self.met("vox", image).groupBy("lor_id").agg(q.alias("q")).where("q <> 0")

    def back(self, lines: DataFrame, value: Column) -> DataFrame:
        """(vox, f): a value of each line (lor_id, ..) times w, summed over the lines through each voxel."""
        return self.met("lor_id", lines).groupBy("vox").agg(F.sum(F.col("w") * value).alias("f"))

    def em(self, image: DataFrame, steps: int, counts: DataFrame | None = None, norm: DataFrame | None = None, mu: DataFrame | None = None, scale: float = 0.5) -> DataFrame:
        """(vox, v) after some EM steps; ``counts`` has (lor_id, n), without it each line counts once."""
        for n in range(steps):
            q = self.forward(image, mu, scale)
            f = self.back(q, 1 / F.col("q")) if counts is None else self.back(q.join(counts, "lor_id"), F.col("n") / F.col("q"))
            image = update(image, f, norm)
            if n + 1 < steps:
                image = cut(image)
        return image
