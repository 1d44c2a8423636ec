import pytest

from braidlake.llm.qa_defects import answer_defects, defect, lcs

Q = "Which object had the old mill lost behind the quiet harbour?"
CASES = [
    (None, "empty"), ("", "empty"), (" ​\n", "empty"), ("N/A", "empty"), ("(no answer)", "empty"), ("Answer:", "empty"), ("...", "empty"),
    ("I'm sorry, but I can't answer that. Please consult another source.", "refusal"), ("Dazu darf ich keine Auskunft geben.", "refusal"), ("No me es posible ayudar con esta consulta.", "refusal"),
    (Q.upper(), "copy"), ("You asked: " + Q, "copy"), (Q[:-1], "copy"), (Q + "\nAnswer:", "copy"),
    ("The old mill lost a kettle. After that the quiet har", "truncated"), ("The old mill lost a kettle because of the", "truncated"), ("The mill lost a kettle and the …", "truncated"),
    ("La meunière a perdu la clé pendant le long hiver.", "other_language"),
    ("the copper kettle", None), ("1. the mill\n2. a kettle\n3. the harbour", None), ("The clerk said sorry and declined, but the mill lost a kettle all the same.", None),
    ("The mill refused to answer and could not help with the kettle; it lost a spoon instead.", None), ('The inscription reads "la rivière sans autorisation", and the mill lost a kettle.', None),
    ("The mill stands by the harbour. It has two wheels. I cannot answer this question any further, though.", "refusal"),
    ("I have read all of the passages that you supplied with the greatest care and in the end I am unable to tell which object it was.", "refusal"),
    ("Mi dispiace, ma non posso rispondere a questa domanda.", "refusal"), ("抱歉，我无法回答这个问题。", "refusal"), ("К сожалению, я не могу ответить на этот вопрос.", "refusal"),
    ("Il vecchio mulino ha perso una caldaia di rame dietro il porto durante la tempesta.", "other_language"), ("Старая мельница потеряла медный котёл за тихой гаванью.", "other_language"), ("老磨坊在安静的港口后面丢了一个铜壶。", "other_language"),
    ('The clerk said that he was sorry and "I cannot answer" stood on the door of the mill, which lost a kettle.', None), ("The miller told them I refuse to pay, and so the mill lost a kettle.", None),
    (Q + " Because the storm broke the gate, the mill had lost a copper kettle that nobody could find in the end.", None),
]


@pytest.mark.parametrize(("answer", "wanted"), CASES)
def test_cases(answer, wanted):
    assert defect(Q, answer) == wanted


def test_lcs_matches_table():
    import random

    random.seed(6)
    for _ in range(100):
        a, b = ([random.choice("abc") for _ in range(random.randrange(12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert lcs(a, b) == t[-1][-1]


def test_table(spark):
    rows = [("a", Q, None, None, "x"), ("a", Q, None, None, "x"), ("b", None, "the mill", None, "x"), ("c", Q, "", "failed", "x"), (None, "", "n/a", None, "x")]
    df = spark.createDataFrame(rows, "id string, question string, generated_answer string, error string, defect string")
    got = sorted((str(r["id"]), r["defect"]) for r in answer_defects(df, "id", "question", "generated_answer", "error").collect())
    assert got == [("None", "empty"), ("a", "empty")]
    assert answer_defects(df.limit(0), "id", "question", "generated_answer", "error").count() == 0


def test_long_answer():
    assert defect(Q, "The mill lost a kettle. " * 20_000) is None
