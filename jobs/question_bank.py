"""Build the bank of asked questions from conversation logs.

    python -m jobs.question_bank --conversations TABLE --output FOLDER [--config FILE]

The bank is what a retriever's first level searches: every question that users have
asked, once, with the best answer it got. User turns of ``conv_id, turn, role,
text`` are brought to the form that duplicates are found by, their intent is told
by keywords, and the assistant's turn right after a question is its answer. Of
equal questions of an intent the one of the longest answer is kept, with how often
and in how many conversations it was asked and where it came first. Written are,
for one ``snapshot``,

* ``bank/snapshot=S/intent=I``: the questions,
* ``report/snapshot=S``: for every intent its questions, how often they were asked
  and answered, and its share of all askings in whole thousandths, rounded down,
* ``top/snapshot=S/intent=I``: the ``top`` questions asked most of every intent.

A run replaces the folders of its snapshot and touches no other, so it may be run
again at any time with the same result.

Defined cases: rows without conv_id or turn are counted and left out; a null text,
and one of punctuation alone, is no question; a question of under ``min_chars``
characters is left out; of repeated turns each asking counts, and the answer is the
longest text (then the last one by its bytes); equal answers are decided by the
least conv_id, then the least turn, then the last text by its bytes; equally frequent questions are ranked
by their form; an intent that nobody asks for is in the report with zeros.

Equal turns are added up before anything is joined, and every grouping adds up
within tasks first, so that one turn in very many copies is no burden to a task.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions import text as t
from leafmill.operators import retrieval
from leafmill.packs import LanguagePack, guideline_pack

from .common import run_from_command_line

log = logging.getLogger("question_bank")

READ = "conv_id bigint, turn int, role string, text string"
BANK = "query_key string, query string, answer string, conv_id bigint, turn int, first_conv bigint, first_turn int, n_asked bigint, n_conversations bigint, intent string"
REPORT = "intent string, n_questions bigint, n_asked bigint, n_answered bigint, thousandths bigint"
TOP = "rank int, query_key string, n_asked bigint, intent string"


def _guideline() -> dict[str, list[str]]:
    pack = guideline_pack()
    return {name: pack.intent_keywords.get(name, []) for name in pack.intents}


@dataclass(frozen=True)
class Config:
    #: Intents and their keywords, in order of precedence; the last takes what no other does.
    intents: dict[str, list[str]] = field(default_factory=_guideline)
    snapshot: str = "current"
    min_chars: int = 1
    top: int = 10
    user: str = "user"
    assistant: str = "assistant"

    def pack(self) -> LanguagePack:
        return LanguagePack(intents=list(self.intents), intent_keywords=self.intents)


def asked(turns: DataFrame, config: Config) -> DataFrame:
    """``(conv_id, turn, query, query_key, intent, answer, n)`` of every distinct user turn."""
    keyed = turns.where(F.col("role") == config.user).withColumn("query_key", t.query_key(F.col("text")))
    keyed = keyed.where(F.length("query_key") >= max(1, config.min_chars))
    users = keyed.groupBy("conv_id", "turn", F.col("text").alias("query"), "query_key").agg(F.count("*").alias("n"))
    said = turns.where((F.col("role") == config.assistant) & F.col("text").isNotNull())
    answers = said.groupBy("conv_id", (F.col("turn") - 1).alias("turn")).agg(F.max(F.struct(F.length("text"), "text"))["text"].alias("answer"))
    return users.join(answers, ["conv_id", "turn"], "left").withColumn("intent", retrieval.intent(F.col("query"), config.pack()))


def banked(questions: DataFrame) -> DataFrame:
    """One row for each intent and query key."""
    def last_first(c: str) -> Column:
        return (-F.col(c)).alias(c)

    size = F.coalesce(F.length("answer"), F.lit(-1)).alias("size")
    best = F.max(F.struct(size, last_first("conv_id"), last_first("turn"), "query", "answer")).alias("_best")
    first = F.min(F.struct("conv_id", "turn")).alias("_first")
    found = questions.groupBy("intent", "query_key").agg(best, first, F.sum("n").alias("n_asked"), F.count_distinct("conv_id").alias("n_conversations"))
    place = [(-F.col(f"_best.{c}")).alias(c) for c in ("conv_id", "turn")]
    return found.select("query_key", "_best.query", "_best.answer", *place, F.col("_first.conv_id").alias("first_conv"), F.col("_first.turn").alias("first_turn"), "n_asked", "n_conversations", "intent")


def intent_report(bank: DataFrame, config: Config) -> DataFrame:
    """One row for each intent, asked for or not."""
    every = bank.sparkSession.createDataFrame([(x,) for x in config.intents], "intent string")
    sums = bank.groupBy("intent").agg(F.count("*").alias("n_questions"), F.sum("n_asked").alias("n_asked"), F.count("answer").alias("n_answered"))
    zero = F.lit(0).cast("bigint")
    # as many rows as there are intents
    told = every.join(sums, "intent", "left").select("intent", *[F.coalesce(c, zero).alias(c) for c in ("n_questions", "n_asked", "n_answered")])
    whole = told.agg(F.sum("n_asked").alias("_all"))
    share = F.when(F.col("_all") > 0, F.floor(F.col("n_asked") * 1000 / F.col("_all"))).otherwise(zero)
    return told.join(F.broadcast(whole)).select("intent", "n_questions", "n_asked", "n_answered", share.alias("thousandths"))


def top_questions(bank: DataFrame, config: Config) -> DataFrame:
    w = Window.partitionBy("intent").orderBy(F.desc("n_asked"), "query_key")
    ranked = bank.select("intent", "query_key", "n_asked").withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= config.top).select("rank", "query_key", "n_asked", "intent")


def build(spark: SparkSession, conversations: str, output: str, config: Config = Config()) -> dict:
    """Write the snapshot's bank, report and top questions; tells what was read and written."""
    own = {name: f"{output}/{name}/snapshot={config.snapshot}" for name in ("bank", "report", "top")}
    lost = F.col("conv_id").isNull() | F.col("turn").isNull()
    log.info("reading %s", conversations)
    turns = spark.read.parquet(conversations).select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in READ.split(", ")])
    told = turns.agg(F.count_if((F.col("role") == config.user) & ~lost).alias("n_user_turns"), F.count_if(lost).alias("n_without_place")).first().asDict()
    bank = banked(asked(turns.where(~lost), config))
    bank.write.mode("overwrite").partitionBy("intent").parquet(own["bank"])
    stored = read_back(spark, output, config.snapshot, "bank")
    intent_report(stored, config).coalesce(1).write.mode("overwrite").parquet(own["report"])
    top_questions(stored, config).write.mode("overwrite").partitionBy("intent").parquet(own["top"])
    told["n_questions"] = stored.count()
    log.info("read %(n_user_turns)d user turns (%(n_without_place)d rows without conv_id or turn), wrote %(n_questions)d questions", told)
    for name, path in own.items():
        log.info("wrote %s to %s", name, path)
    return told


def read_back(spark: SparkSession, output: str, snapshot: str, name: str) -> DataFrame:
    """One of the tables of a snapshot."""
    schema = {"bank": BANK, "report": REPORT, "top": TOP}[name]
    return spark.read.schema(schema).parquet(f"{output}/{name}/snapshot={snapshot}")


def main(argv: list[str] | None = None) -> dict:
    paths = {"conversations": "Parquet table of turns", "output": "folder of the bank"}
    return run_from_command_line("question_bank", __doc__, paths, Config, build, argv)


if __name__ == "__main__":
    main()
