"""Token and cost tables over usage logs. Prices are per million tokens."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semaspark.operators.selection import exact_percentiles, first_per_group, join_groups, pareto

__all__ = ["token_stats", "size_buckets", "run_cost", "stepwise_cost", "hybrid_cost", "budget", "project_cost", "apply_discounts",
           "pareto", "early_stop", "request_cost"]


def token_stats(df: DataFrame, by: Sequence[str], tokens: str) -> DataFrame:
    """``min, median, mean, max, p95`` of a token count per component."""
    base = df.groupBy(*by).agg(F.min(tokens).alias("min"), F.avg(F.col(tokens).cast("bigint")).alias("mean"), F.max(tokens).alias("max"))
    return join_groups(base, exact_percentiles(df, by, tokens, {"median": 0.5, "p95": 0.95}), by, "left")


def size_buckets(df: DataFrame, tokens: str, edges: Sequence[int] = (100, 300, 500)) -> DataFrame:
    """``bucket, n, percent``; the total is a sum over the few buckets, not over the rows."""
    label = F.when(F.col(tokens) < edges[0], f"< {edges[0]}")
    for low, high in zip(edges, edges[1:]):
        label = label.when(F.col(tokens) < high, f"{low}-{high}")
    counted = df.groupBy(label.otherwise(f"{edges[-1]}+").alias("bucket")).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n")).scalar()
    return counted.select("bucket", "n", (F.lit(100.0) * F.col("n") / total).alias("percent"))


def request_cost(input_tokens: Column, output_tokens: Column, input_per_m: Column, output_per_m: Column) -> Column:
    """Exact decimal cost in the price's currency."""
    def part(tokens: Column, price: Column) -> Column:
        return tokens.cast("decimal(18,0)") * price.cast("decimal(18,9)")

    return (part(input_tokens, input_per_m) + part(output_tokens, output_per_m)) * F.lit(Decimal("0.000001"))


def _with_each_price(df: DataFrame, prices: DataFrame) -> DataFrame:
    """Every row of a small aggregate with every price; the price list is one array."""
    listed = prices.agg(F.collect_list(F.struct("model", "input_per_m", "output_per_m"))).scalar()
    return df.select("*", F.explode(listed).alias("price")).select(*df.columns, "price.*")


def _totals(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


def run_cost(usage: DataFrame, prices: DataFrame, per: str = "question_id") -> DataFrame:
    """``model, questions, input_cost, output_cost, total_cost, per_question``: what the log would
    cost with each priced model. Tokens are summed before prices are applied."""
    totals = usage.agg(F.sum("input_tokens").alias("i"), F.sum("output_tokens").alias("o"), F.count_distinct(per).alias("questions"))
    priced = _with_each_price(totals, prices)
    zero = F.lit(0)
    return priced.select(
        "model", "questions", request_cost(F.col("i"), zero, F.col("input_per_m"), F.col("output_per_m")).alias("input_cost"),
        request_cost(zero, F.col("o"), F.col("input_per_m"), F.col("output_per_m")).alias("output_cost"),
        request_cost(F.col("i"), F.col("o"), F.col("input_per_m"), F.col("output_per_m")).alias("total_cost")).withColumn(
        "per_question", F.try_divide(F.col("total_cost").cast("double"), F.col("questions")))


def stepwise_cost(usage: DataFrame, prices: DataFrame, shares: dict[str, float] | None = None) -> DataFrame:
    """``model, step, cost`` and, with ``step`` NULL, the total per model. ``shares`` scales a step
    that only part of the questions need, such as a correction step."""
    steps = _totals(usage, ["step"])
    share = F.lit(Decimal("1"))
    for step, value in (shares or {}).items():
        share = F.when(F.col("step") == step, F.lit(Decimal(str(value)))).otherwise(share)
    priced = _with_each_price(steps.withColumn("share", share.cast("decimal(6,4)")), prices)
    cost = request_cost(F.col("input_tokens"), F.col("output_tokens"), F.col("input_per_m"), F.col("output_per_m")).cast("decimal(28,10)")
    return (priced.select("model", "step", (cost * F.col("share")).alias("cost")).rollup("model", "step")
            .agg(F.sum("cost").alias("cost")).filter("model is not null"))


def hybrid_cost(usage: DataFrame, assignment: DataFrame, prices: DataFrame) -> DataFrame:
    """``configuration, total_cost`` where ``assignment`` names one model per configuration and step."""
    steps = _totals(usage, ["step"])
    priced = assignment.join(steps, "step").join(prices, "model")
    cost = request_cost(F.col("input_tokens"), F.col("output_tokens"), F.col("input_per_m"), F.col("output_per_m"))
    return priced.groupBy("configuration").agg(F.sum(cost).alias("total_cost"))


def budget(items: DataFrame, buffer: float = 0.2, digits: int = 2) -> DataFrame:
    """``phase, cost``: a subtotal per phase, then ``buffer`` and ``total`` rows."""
    cost = F.sum(F.col("cost").cast("decimal(18,4)"))
    rolled = items.rollup("phase").agg(cost.alias("cost"), F.grouping("phase").alias("all"))
    phases = rolled.filter("all = 0").select("phase", F.col("cost").cast("double").alias("cost"))
    total = rolled.filter("all = 1").select(F.col("cost").cast("double").alias("cost"))
    reserve = F.round(F.col("cost") * buffer, digits)
    extra = total.select(F.explode(F.array(F.struct(F.lit("buffer").alias("phase"), reserve.alias("cost")),
                                           F.struct(F.lit("total").alias("phase"), (F.col("cost") + reserve).alias("cost")))).alias("e"))
    return phases.unionByName(extra.select("e.*"))


def project_cost(costs: DataFrame, questions: int, to: int, digits: int = 2) -> DataFrame:
    """Adds ``projected``: the cost of ``to`` questions at the rate of ``questions``."""
    return costs.withColumn("projected", F.round(F.col("cost") * F.lit(to) / F.lit(questions), digits))


def apply_discounts(usage: DataFrame, prices: DataFrame, by: Sequence[str], cached: float = 0.9, batch: float = 0.5) -> DataFrame:
    """Cost per group with cached input and batched requests at a discount.

    Tokens are summed per model and kind of request first, so prices meet a handful of rows."""
    keys = list(dict.fromkeys([*by, "model", "cached", "batch"]))
    priced = _totals(usage, keys).join(prices, "model")
    one, zero = F.lit(Decimal("1.0000")), F.lit(0)

    def share(flag: str, discount: float) -> Column:
        return F.when(F.col(flag), F.lit(1 - Decimal(str(discount))).cast("decimal(5,4)")).otherwise(one)

    # Discounts are decimal factors on exact costs; a discounted price may have more digits than a price.
    input_cost = request_cost(F.col("input_tokens"), zero, F.col("input_per_m"), F.col("output_per_m")).cast("decimal(28,15)")
    output_cost = request_cost(zero, F.col("output_tokens"), F.col("input_per_m"), F.col("output_per_m")).cast("decimal(28,15)")
    list_price = input_cost + output_cost
    paid = ((input_cost * share("cached", cached)).cast("decimal(30,17)") + output_cost) * share("batch", batch)
    return priced.groupBy(*by).agg(F.sum(list_price).alias("list_cost"), F.sum(paid).alias("paid_cost"))


def early_stop(results: DataFrame, by: Sequence[str], order: Sequence[str], n: int, threshold: float) -> DataFrame:
    """``seen, correct, accuracy, stop`` after the first ``n`` results of each configuration; one with
    fewer than ``n`` results is not stopped."""
    first = first_per_group(results, by, [F.col(c) for c in order], n, order)
    out = first.groupBy(*by).agg(F.count("*").alias("seen"), F.count_if("match").alias("correct"))
    rate = F.try_divide(F.col("correct"), F.col("seen"))
    return out.select(*by, "seen", "correct", rate.alias("accuracy"), ((F.col("seen") >= n) & (rate < threshold)).alias("stop"))
