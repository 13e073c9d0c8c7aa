"""Embeddings: centroids, quantization, nearest labels, a linear probe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def centroids(rows: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, dim, mean, lift): mean per label and dimension, and its difference to the mean of all."""
    each = rows.where(F.col(vector).isNotNull()).select(label, F.posexplode(vector).alias("dim", "x"))
    fixed = F.round(F.col("x").cast("double") * 1e6).cast("bigint")  # exact sums in any order
    per = each.groupBy(label, "dim").agg(F.sum(fixed).alias("s"), F.count(F.lit(1)).alias("n"))
    whole = per.groupBy("dim").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    mean = lambda s, n: F.col(s).cast("double") / F.col(n) / F.lit(1e6)
    return per.join(F.broadcast(whole), "dim").select(label, "dim", mean("s", "n").alias("mean"), (mean("s", "n") - mean("ts", "tn")).alias("lift"))


def quantized(vector: str, bits: int = 8) -> tuple[Column, Column]:
    """(scale, codes): symmetric whole-number codes of a row."""
    top = (1 << bits - 1) - 1
    scale = F.greatest(F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double")))), F.lit(1e-8)) / F.lit(float(top))
    codes = F.transform(vector, lambda x: F.greatest(F.lit(-top), F.least(F.lit(top), F.rint(x.cast("double") / scale).cast("int"))))
    return scale, codes


def cosine(a: str, b: str) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.try_divide(dot, norm(a) * norm(b))


def linear_probe(rows: DataFrame, label: str, vector: str, seed_column: str, held: float = 0.2):
    """Fit a logistic regression on standardized vectors of the training part; returns (model, accuracy, majority share)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector

    data = rows.select(F.col(label).cast("double").alias("label"), array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("x"), F.pmod(F.xxhash64(seed_column), F.lit(1000)).alias("u"))
    train, test = data.where(F.col("u") >= held * 1000), data.where(F.col("u") < held * 1000)
    model = Pipeline(stages=[StandardScaler(inputCol="x", outputCol="z", withMean=True), LogisticRegression(featuresCol="z", maxIter=50, regParam=1e-3)]).fit(train)
    right = model.transform(test).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).head()[0]
    top = test.groupBy("label").count().agg(F.max("count") / F.sum("count")).head()[0]
    return model, right, top


def direction_cosines(rows: DataFrame, label: str, vector: str) -> DataFrame:
    """(a, b, cosine): cosines of the labels' unit directions, a label's mean minus the mean of all. Labels are few."""
    lifts = centroids(rows, label, vector).select(F.col(label).alias("l"), "dim", "lift")
    norms = lifts.groupBy("l").agg((F.sqrt(F.sum(F.col("lift") * F.col("lift"))) + 1e-6).alias("norm"))
    unit = lifts.join(norms, "l").select("l", "dim", (F.col("lift") / F.col("norm")).alias("u"))
    a, b = unit.alias("a"), unit.alias("b")
    pairs = a.join(b, (F.col("a.dim") == F.col("b.dim")) & (F.col("a.l") < F.col("b.l")))
    return pairs.groupBy(F.col("a.l").alias("a"), F.col("b.l").alias("b")).agg(F.sum(F.col("a.u") * F.col("b.u")).alias("cosine"))


def int4(rows: DataFrame, vector: str) -> DataFrame:
    """Adds ``scale``, ``packed`` (two 4-bit codes a byte, the first one low, offset by 8) and ``max_error`` after unpacking."""
    scale, codes = quantized(vector, 4)
    staged = rows.withColumn("scale", scale).withColumn("__c", codes)
    pairs = F.sequence(F.lit(0), F.floor((F.size("__c") + 1) / 2).cast("int") - 1)
    low, high = lambda i: F.get("__c", i * 2) + 8, lambda i: F.coalesce(F.get("__c", i * 2 + 1), F.lit(0)) + 8
    packed = F.transform(pairs, lambda i: low(i).bitwiseOR(F.shiftleft(high(i), 4)))
    staged = staged.withColumn("packed", F.when(F.size("__c") > 0, packed).otherwise(F.array().cast("array<int>")))
    unpacked = F.flatten(F.transform("packed", lambda x: F.array(x.bitwiseAND(F.lit(15)) - 8, F.shiftright(x, 4) - 8)))
    error = F.array_max(F.zip_with(vector, F.slice(unpacked, F.lit(1), F.size(vector)), lambda x, c: F.abs(x.cast("double") - c * F.col("scale"))))
    return staged.withColumn("max_error", error).drop("__c")
