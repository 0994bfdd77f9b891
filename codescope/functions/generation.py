"""Generation-side data functions: X16 token estimate lives in text; here X17
cost, X18 prompt text and sampling parameters, S7 seed registry rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- fixed values ----
INSTRUCTION_PREFIX = ("You are an expert software engineer. Respond with ONLY a single "
                      "fenced code block containing a complete, runnable solution.\n\n")
MIN_TEMPERATURE = 0.01
DEFAULT_RATE_PER_1K = 0.03
PRICING_PER_1K = [("gpt-4", 0.03), ("gpt-4o-mini", 0.00015)]
NON_BILLED_PROVIDERS = ["huggingface", "local"]
SEED_MODELS = [
    ("gpt-4", "openai", "gpt-4-turbo", 128000),
    ("gpt-4o-mini", "openai", "gpt-4o-mini", 128000),
    ("llama-3-70b", "huggingface", "meta-llama/Meta-Llama-3-70B-Instruct", 8192),
    ("gemma-7b", "huggingface", "google/gemma-7b-it", 8192),
]
# -----------------------


def seed_registry(spark: SparkSession) -> DataFrame:
    """The four default models as a registry table."""
    rows = [(f"seed-{n}", n, p, v, c, True) for n, p, v, c in SEED_MODELS]
    return spark.createDataFrame(rows, "id string, name string, provider string, version string, "
                                       "context_window int, is_active boolean")


def rate_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRICING_PER_1K, "model_name string, rate_per_1k double")


def generation_cost(tokens: Column, rate: Column, provider: Column) -> Column:
    """tokens/1000 × rate; non-billed providers cost 0.0."""
    return F.when(provider.isin(*NON_BILLED_PROVIDERS), F.lit(0.0)).otherwise(tokens / 1000.0 * rate)


def prompt_text(statement: Column) -> Column:
    """The instruction prefix in front of the problem statement."""
    return F.concat(F.lit(INSTRUCTION_PREFIX), statement)


def sampling_temperature(t: Column) -> Column:
    """Temperature floor 0.01 (hosted endpoints reject 0)."""
    return F.greatest(t, F.lit(MIN_TEMPERATURE))


def do_sample(t: Column) -> Column:
    return t > 0
