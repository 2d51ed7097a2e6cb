"""k-nearest-neighbour learner on top of the exact neighbour join."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mlscout.operators.neighbours import weighted_neighbours
from mlscout.operators.task import REGRESSION


@dataclass
class NeighbourVote:
    """Weighted mean of, or vote among, the k nearest training rows (vote tie: first class)."""

    task_type: str
    k: int
    n_classes: int
    kernel: str = "rectangular"

    def fit(self, features: DataFrame) -> NeighbourVoteModel:
        stored = features.select(
            F.col("label").cast("double").alias("label"),
            vector_to_array("features").alias("point"),
        )
        return NeighbourVoteModel(self.task_type, self.k, self.n_classes, stored, self.kernel)


@dataclass
class NeighbourVoteModel:
    task_type: str
    k: int
    n_classes: int
    train: DataFrame
    kernel: str = "rectangular"

    def transform(self, features: DataFrame) -> DataFrame:
        """Neighbours are found once per distinct point and joined back to its rows."""
        # copies of a (point, label) pair are numbered per pair: any k + 1 of them are enough
        keyed = self.train.select(
            F.xxhash64("point", "label").alias("key"), "point", "label"
        )
        copies = keyed.groupBy("key", "point", "label").agg(F.count("*").alias("n"))
        numbered = copies.withColumn(
            "copy", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(self.k + 1)).cast("int")))
        ).select(F.struct("key", "copy", "label").alias("member"), "point")
        tagged = features.withColumn("_point", vector_to_array("features"))
        found = weighted_neighbours(
            numbered.select(
                F.concat_ws(
                    ":",
                    F.lpad(F.hex("member.key"), 16, "0"),
                    F.lpad(F.col("member.copy").cast("string"), 4, "0"),
                    F.col("member.label").cast("string"),
                ).alias("key"),
                "point",
            ),
            tagged.select(F.col("_point").alias("point")),
            self.k,
            self.kernel,
        ).withColumn("label", F.substring_index("key", ":", -1).cast("double"))
        if self.task_type == REGRESSION:
            mean = F.sum(F.col("weight") * F.col("label")) / F.sum("weight")
            votes = found.groupBy("point").agg(mean.alias("prediction"))
        else:
            shares = [
                (F.sum(F.when(F.col("label") == float(c), F.col("weight")).otherwise(0.0)) / F.sum("weight"))
                .alias(f"p{c}")
                for c in range(self.n_classes)
            ]
            votes = (
                found.groupBy("point")
                .agg(*shares)
                .select(
                    "point", F.array(*[f"p{c}" for c in range(self.n_classes)]).alias("probability")
                )
            )
            best = F.array_position("probability", F.array_max("probability")) - 1
            votes = votes.withColumn("prediction", best.cast("double"))
        return tagged.join(votes.withColumnRenamed("point", "_point"), "_point").drop("_point")

    def save(self, path: str) -> None:
        self.train.write.mode("overwrite").parquet(path)

    @staticmethod
    def load(
        spark: SparkSession, path: str, task_type: str, k: int, n_classes: int, kernel: str = "rectangular"
    ) -> NeighbourVoteModel:
        return NeighbourVoteModel(task_type, k, n_classes, spark.read.parquet(path), kernel)
