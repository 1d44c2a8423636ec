import json

import pytest

from braidlake.functions.models import Cooldown, Refused, asked, complete, retrying
from braidlake.operators import judging

SCHEMA = "id int, question string, answer string, gold string, contexts array<string>"
ROWS = [
    (1, "who swim", "Otters swim. Kettles shine.", "Otters swim in rivers.", ["Otters swim in the rivers", " "]),
    (2, "who", "", None, ["x"]),
    (3, "who", "Otters swim.", "Otters swim.", None),
    (4, None, None, " ", []),
]


def scores(df, into="score"):
    return {r["id"]: r[into] for r in df.collect()}


def test_default_judge(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert scores(judging.with_faithfulness(df, "question", "answer", "contexts", "score")) == {1: 0.5, 2: 1.0, 3: 0.0, 4: 1.0}
    assert scores(judging.with_coverage(df, "question", "gold", "answer", "score")) == {1: 1.0, 2: 1.0, 3: 1.0, 4: 1.0}
    assert scores(judging.with_context_recall(df, "question", "contexts", "gold", "score")) == {1: 1.0, 2: None, 3: 0.0, 4: None}
    assert scores(judging.with_context_relevance(df, "question", "contexts", "score")) == {1: 0.5, 2: 0.0, 3: 0.0, 4: 0.0}
    got = scores(judging.with_correctness(df, "question", "answer", "gold", "score"))
    assert got[3] == pytest.approx(1.0) and got[2] == got[4] == 1.0 and 0.5 < got[1] < 1.0
    assert judging.with_faithfulness(df.limit(0), "question", "answer", "contexts", "score").count() == 0


def test_repair_and_counts(spark):
    class Wrong:
        """Replies with chatter first; after the repair request with one verdict too many."""

        def generate(self, prompts):
            out = []
            for p in prompts:
                if "PREVIOUS" not in p:
                    out.append("let me think")
                elif "TASK: statements" in p:
                    out.append(json.dumps({"statements": ["a", " ", "b"]}))
                else:
                    verdicts = [{"statement": "a", "verdict": v} for v in (True, "0", "1")]
                    out.append("```" + json.dumps({"verdicts": verdicts, "relevance": 3}) + "```")
            return out

    df = spark.createDataFrame(ROWS[:1], SCHEMA)
    assert scores(judging.with_faithfulness(df, "question", "answer", "contexts", "score", Wrong())) == {1: None}
    assert scores(judging.with_context_relevance(df, "question", "contexts", "score", Wrong())) == {1: None}
    assert scores(judging.with_coverage(df, "question", "gold", "answer", "score", Wrong())) == {1: None}


def test_asked_and_cooldown(spark):
    class Slow:
        def generate(self, prompts):
            return ["{" if "PREVIOUS" not in p else "{}" for p in prompts]

    df = spark.createDataFrame([("a",), (None,)], "p string")
    assert [r[0] for r in df.select(asked("p", Slow()).alias("r")).collect()] == ["{}", None]
    assert [r[0] for r in df.select(asked("p", Slow(), attempts=1).alias("r")).collect()] == [None, None]
    assert complete("{}") and not complete("<answer>half") and not complete(" ") and not complete(None)
    slept, now = [], [0.0]
    pause = Cooldown(30, lambda: now[0], lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))
    tries = []

    def call():
        tries.append(1)
        if len(tries) < 3:
            raise Refused
        return "ok"

    assert retrying(call, attempts=3, cooldown=pause) == "ok" and slept == [30, 30]
    with pytest.raises(Refused):
        retrying(lambda: (_ for _ in ()).throw(Refused()), attempts=2, cooldown=pause)
