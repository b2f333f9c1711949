"""How queries and their SQL are registered, and the word lists the queries use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlens.runtime import table

TWEETS, KEPT, FLAGS = "tweet_there_is_no_amount_of", "filtered_v1_kept", "human_kenya_final_validation_flags"

# Word lists of the queries, invented for the test tables; in use, lists are tables of the corpus at hand.
HIGH_TERMS = ("weakness", "school fees", "grew up", "forgiveness", "marriage")
MODERATE_TERMS = ("money", "respect", "anger", "prayer", "patience", "discipline", "trust", "friendship")
CONTEXT_TERMS = ("father", "uncle", "brother", "boys", "husband", "son")
GENERIC_TERMS = ("money", "prayer")
PLAIN_TERMS = ("money", "respect", "anger", "father", "silence", "work", "pride", "trust", "uncle", "boys")
FAITH_TERMS = ("prayer", "proverbs", "god", "mungu", "maombi")
THEMES = {
    "family": ["father|mother|uncle|brother", "child|boys|son"],
    "money": ["money|rent|fees", "job|work"],
    "emotion": ["anger|cry|sorry", "silence|hide", "weakness"],
    "faith": ["prayer|god", "forgiveness"],
}
POSITIVE, NEGATIVE = ["thank", "true for me", "helped", "in a new way"], ["disagree", "blam", "never said sorry", "very hard", "hide"]
HINTS = {
    "gender": ("boys", "men ", "woman", "husband"),
    "stance": ("agree", "blaming", "needs"),
    "experience": ("i grew", "my ", "i lost"),
    "learning": ("taught", "think about"),
    "change": ("new way", "finally"),
    "reinforcement": ("thank you", "helped"),
    "action": ("let us", "need more", "listen"),
    "info": ("go to", "minute"),
    "identity": ("weakness", "pride", "respect"),
}
LOW_CONTENT = ("amen", "nice", "ok", "true", "wow", "preach", "facts", "kamwe")
AUXILIARY = r"(^|[^a-z])(is|are|was|were|has|have|should|must|can|will)([^a-z]|$)"


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


class Registry:
    """Collects queries with their SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None, name: str | None = None):
        def register(f):
            key = name or f.__name__
            if key in self.queries:
                raise ValueError(f"two queries {key}")
            self.queries[key] = f
            if sql is not None:
                self.sql[key] = sql
            return f

        return register

    def scalar(self, name: str, source: str, key: str, columns: dict[str, tuple[Callable[[Column, Column], Column], str]], where: str | None = None, renamed: str = "t", text: str = "text") -> None:
        """A query of expressions over one column ``text`` of a table, row by row: it is ``t`` in both forms, and ``low`` in lower case."""

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = table(spark, sf_dir, source).select(key, F.col(text).alias(renamed))
            if where:
                df = df.filter(where)
            t = F.col(renamed)
            return df.select(key, *(c(t, F.lower(t)).alias(n) for n, (c, _) in columns.items()))

        self.queries[name] = run
        picked = ", ".join(f"{s} as {n}" for n, (_, s) in columns.items())
        self.sql[name] = f"select {key}, {picked} from (select {key}, {text} as {renamed} from {source})" + (f" where {where}" if where else "")
