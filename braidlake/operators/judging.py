"""Judged metrics of answers: statements, verdicts and facts asked of a model, checked, and turned into scores.

A judge is a generator (`functions.models.Generator`) that replies to a prompt with one JSON object. A prompt names its
task in the first line and carries its input as JSON after `INPUT:`. A reply without the lists its task asks for is asked
for again with a repair request; after the last attempt the score is null. All rows of a batch go to the judge together.

Scores are null where a reply stays invalid, or where a judge gives another number of verdicts than there are statements.
Reasons of verdicts are accepted and not used. Formulas are those of `evaluation`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidlake.functions import text as T
from braidlake.functions import vectors as V
from braidlake.functions.models import asked, embed_column
from braidlake.operators import evaluation
from braidlake.operators.entities import _is_object
from braidlake.runtime import checkpointed

_TEXTS = "array<string>"
_JUDGED = "array<struct<statement string, verdict string, attributed string>>"
REPAIR = "The previous reply was invalid. Reply with exactly one JSON object with the lists that were asked for."


class OverlapJudge:
    """The default judge: sentences are statements and facts; a statement is supported by a text that holds at least half
    of its tokens; relevance counts how far the question's tokens stand in the context, in thirds."""

    def generate(self, prompts) -> list[str]:
        import json
        import re

        def tokens(x: str) -> list[str]:
            return [t for t in re.split("[^a-z0-9]+", (x or "").lower()) if t]

        def sentences(x: str) -> list[str]:
            return [s for s in (p.strip(" \t\r\n") for p in re.split(r"(?<=[.!?])[ \t\r\n]+", x or "")) if s]

        def supported(statement: str, held: set[str]) -> int:
            own = tokens(statement)
            return int(bool(own) and 2 * sum(t in held for t in own) >= len(own))

        out = []
        for p in prompts:
            task, given = p.rsplit("TASK: ", 1)[1].split("\n", 1)[0], json.loads(p.rsplit("INPUT:", 1)[1])
            held = set(tokens(given.get("context", "")))
            if task in ("statements", "facts"):
                reply = {task: sentences(given["text"])}
            elif task == "verdicts":
                reply = {"verdicts": [{"statement": s, "verdict": supported(s, held), "reason": "overlap"} for s in given["statements"]]}
            elif task == "coverage":
                reply = {"classifications": [{"statement": s, "attributed": supported(s, held)} for s in given["statements"]]}
            elif task == "recall":
                reply = {"classifications": [{"statement": s, "reason": "overlap", "attributed": supported(s, held)} for s in sentences(given["text"])]}
            elif task == "factuality":
                truth, answer = set(tokens(" ".join(given["truth"]))), set(tokens(" ".join(given["answer"])))
                hit = [s for s in given["answer"] if supported(s, truth)]
                wrap = lambda xs: [{"statement": s, "reason": "overlap"} for s in xs]
                reply = {"TP": wrap(hit), "FP": wrap(s for s in given["answer"] if s not in hit), "FN": wrap(s for s in given["truth"] if not supported(s, answer))}
            else:
                own = tokens(given.get("question", ""))
                reply = {"relevance": min(2, 3 * sum(t in held for t in own) // len(own)) if own else 0}
            out.append(json.dumps(reply))
        return out


def _reply(task: str, given: Column, needs: tuple[str, ...], schema: str, judge, attempts: int) -> Column:
    """The parsed reply to a task, null if it stays invalid; a null input isn't asked."""
    prompt = F.when(given.isNotNull(), F.concat(F.lit(f"TASK: {task}\nReply with one JSON object.\nINPUT:"), F.to_json(given)))
    valid = lambda reply: _is_object(reply, needs)
    return F.from_json(T.json_object(asked(prompt, judge, valid, REPAIR, attempts)), schema)


def _verdicts(items: Column, field: str) -> Column:
    """The readable verdicts of statements that aren't blank."""
    read = F.transform(F.coalesce(items, F.array().cast(_JUDGED)), lambda x: F.struct(x["statement"].alias("statement"), T.verdict(x[field]).alias("v")))
    return F.transform(F.filter(read, lambda x: (F.trim(F.coalesce(x["statement"], F.lit(""))) != "") & x["v"].isNotNull()), lambda x: x["v"])


def _mean(verdicts: Column) -> Column:
    return F.when(F.size(verdicts) > 0, F.aggregate(verdicts, F.lit(0.0), lambda s, v: s + v) / F.size(verdicts))


def _context(contexts: str) -> Column:
    return F.array_join(T.filled(contexts), "\n\n")


def _blank(x: str) -> Column:
    return T.strip(F.coalesce(F.col(x), F.lit(""))) == ""


def with_faithfulness(df: DataFrame, question: str, answer: str, contexts: str, into: str, judge=None, attempts: int = 3) -> DataFrame:
    """Adds the share of the answer's statements that the contexts (an array) support: 1 for a blank answer, 0 without a
    context, null where the judge fails or its verdicts don't match the statements in number."""
    model = judge or OverlapJudge()
    given = F.when(~_blank(answer), F.struct(F.coalesce(F.col(question), F.lit("")).alias("question"), T.strip(answer).alias("text")))
    rows = checkpointed(df.withColumn("_st", T.filled(_reply("statements", given, ("statements",), f"statements {_TEXTS}", model, attempts)["statements"])))
    some = F.size("_st") > 0
    told = F.when(some & (_context(contexts) != ""), F.struct(F.col("_st").alias("statements"), _context(contexts).alias("context")))
    verdicts = _verdicts(_reply("verdicts", told, ("verdicts",), f"verdicts {_JUDGED}", model, attempts)["verdicts"], "verdict")
    read = rows.withColumn("_v", verdicts)
    score = F.when(_blank(answer), 1.0).when(~some, None).when(_context(contexts) == "", 0.0).when(F.size("_v") == F.size("_st"), _mean(F.col("_v")))
    return read.withColumn(into, score).drop("_st", "_v")


def with_coverage(df: DataFrame, question: str, reference: str, answer: str, into: str, judge=None, attempts: int = 3) -> DataFrame:
    """Adds the share of the reference's facts that the answer holds: 1 for a blank reference, null where the judge fails or
    its classifications don't match the facts in number."""
    model = judge or OverlapJudge()
    given = F.when(~_blank(reference), F.struct(F.coalesce(F.col(question), F.lit("")).alias("question"), T.strip(reference).alias("text")))
    rows = checkpointed(df.withColumn("_st", T.filled(_reply("facts", given, ("facts",), f"facts {_TEXTS}", model, attempts)["facts"])))
    told = F.when(F.size("_st") > 0, F.struct(F.col("_st").alias("statements"), F.coalesce(T.strip(answer), F.lit("")).alias("context")))
    verdicts = _verdicts(_reply("coverage", told, ("classifications",), f"classifications {_JUDGED}", model, attempts)["classifications"], "attributed")
    read = rows.withColumn("_v", verdicts)
    return read.withColumn(into, F.when(_blank(reference), 1.0).when((F.size("_st") > 0) & (F.size("_v") == F.size("_st")), _mean(F.col("_v")))).drop("_st", "_v")


def with_context_recall(df: DataFrame, question: str, contexts: str, reference: str, into: str, judge=None, attempts: int = 3) -> DataFrame:
    """Adds the share of the reference's statements, as the judge cuts it, that the contexts support."""
    given = F.struct(F.coalesce(F.col(question), F.lit("")).alias("question"), F.coalesce(F.col(reference), F.lit("")).alias("text"), _context(contexts).alias("context"))
    read = df.withColumn("_v", _verdicts(_reply("recall", given, ("classifications",), f"classifications {_JUDGED}", judge or OverlapJudge(), attempts)["classifications"], "attributed"))
    return read.withColumn(into, _mean(F.col("_v"))).drop("_v")


def with_context_relevance(df: DataFrame, question: str, contexts: str, into: str, judge=None, attempts: int = 3) -> DataFrame:
    """Adds the judge's rating of the contexts, 0 to 2, halved; another rating is no score."""
    given = F.struct(F.coalesce(F.col(question), F.lit("")).alias("question"), _context(contexts).alias("context"))
    read = df.withColumn("_v", _reply("relevance", given, (), "relevance int", judge or OverlapJudge(), attempts)["relevance"])
    return read.withColumn(into, evaluation.relevance("_v")).drop("_v")


def with_correctness(df: DataFrame, question: str, answer: str, reference: str, into: str, judge=None, embedder=None, weights: tuple[float, float] = (0.5, 0.5), attempts: int = 3) -> DataFrame:
    """Adds the weighted mean of factuality (TP over TP and FN) and similarity of the texts' vectors: 1 if both texts are
    blank, null where the judge gives no statements for one of them or no classification."""
    model = judge or OverlapJudge()
    a, b = weights
    both = _blank(answer) & _blank(reference)
    ask_for = lambda x: T.filled(_reply("statements", F.when(~_blank(x), F.struct(T.strip(x).alias("text"))), ("statements",), f"statements {_TEXTS}", model, attempts)["statements"])
    rows = checkpointed(df.withColumn("_sa", ask_for(answer)).withColumn("_sr", ask_for(reference)))
    some = (F.size("_sa") > 0) & (F.size("_sr") > 0)
    told = F.when(some, F.struct(F.coalesce(F.col(question), F.lit("")).alias("question"), F.col("_sa").alias("answer"), F.col("_sr").alias("truth")))
    item = "array<struct<statement string, reason string>>"
    reply = _reply("factuality", told, ("TP", "FP", "FN"), f"TP {item}, FP {item}, FN {item}", model, attempts)
    count = lambda x: F.size(F.filter(x, lambda s: F.trim(F.coalesce(s["statement"], F.lit(""))) != ""))
    read = rows.withColumn("_f", reply)
    fact = F.when(F.col("_f").isNotNull(), evaluation.factuality(count(F.col("_f.TP")), count(F.col("_f.FN"))))
    read = embed_column(embed_column(read, answer, "_va", embedder), reference, "_vr", embedder)
    score = F.when(both, 1.0).otherwise(evaluation.weighted(fact, V.text_similarity(answer, reference, "_va", "_vr"), a, b))
    return read.withColumn(into, score).drop("_sa", "_sr", "_f", "_va", "_vr")
