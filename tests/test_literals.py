"""Literal checks on hand-made pairs: expected state per category."""

import pytest
from pyspark.sql import functions as F

from twinfold.functions import literals as lit
from twinfold.functions import multiset as ms
from twinfold.functions import text as tx
from twinfold.operators.qc import checks, scopes

PAIRS = [
    # id, lang, source, draft, expected states
    (1, "ko", "Give 2.5 mg.", "2.5 mg 투여.", {"number": "checked", "unit": "checked"}),
    (2, "ko", "Give 2.5 mg.", "3.5 mg 투여.", {"number": "warning", "unit": "warning"}),
    (3, "es", "Give 150-mg now.", "Dar 150 mg ahora.", {"number": "checked", "unit": "checked"}),
    (4, "ar", "Give 12 mg.", "أعط ١٢ mg.", {"number": "checked", "unit": "not assessed"}),
    (5, "ko", "BRCA1 and HER-2.", "BRCA1과 HER‐2.", {"identifier": "checked"}),
    (6, "ko", "BRCA1 here.", "BRCA2 여기.", {"identifier": "warning"}),
    (7, "ko", "The proximal part.", "원위 부분.", {"direction": "warning"}),
    (8, "es", "It was not seen.", "Fue visto.", {"negation": "warning"}),
    (9, "es", "It may not be seen.", "Fue visto.", {"negation": "not assessed"}),
    (10, "es", "Not only that.", "Eso.", {"negation": "not assessed"}),
    (11, "ko", "1.5e-3 was used.", "15e-4 사용.", {"number": "checked"}),
    (12, "ko", "1.5e-3 was used.", "0.0015 사용.", {"number": "not assessed"}),
    (13, "ko", "Take once daily.", "1일 1회 복용.", {"number": "checked"}),
    (14, "ko", "The femoral vein is open.", "혈관이 열려 있다.", {"terminology": "warning"}),
    (15, "ko", "The femoral vein is open.", "대퇴 정맥이 열려 있다.", {"terminology": "checked"}),
    (16, "fr", "No text.", "Texte.", {"negation": "not assessed", "number": "not assessed"}),
    (17, "ko", "The 2.5 mg dose was not recorded.", "2.5 mg 용량은 기록되지 않았습니다.", {"negation-scope": "checked"}),
    (18, "ko", "The 2.5 mg dose was not recorded.", "2.5 mg 용량은 기록되었습니다.", {"negation-scope": "warning"}),
    (19, "ko", "The 2.5 mg dose was not seen and kept.", "2.5 mg 용량.", {"negation-scope": "not assessed"}),
    (20, "es", "Value ,5 or 1,5.", "Valor ,5 o 1.5.", {"number": "checked"}),
]


@pytest.fixture(scope="module")
def states(spark):
    df = spark.createDataFrame([p[:4] for p in PAIRS], "pair_id int, lang string, source string, draft string")
    rows = checks.coverage(checks.evaluate(df)).collect()
    return {(r.pair_id, r.category): r.state for r in rows}


@pytest.mark.parametrize("pair", PAIRS, ids=lambda p: str(p[0]))
def test_states(states, pair):
    for category, state in pair[4].items():
        assert states[(pair[0], category)] == state, category
    assert states[(pair[0], "omission")] == "not assessed"


def test_scientific_keys(spark):
    tokens = ["1.5e-3", "15E-4", "0e9", "+2.50e1", "1e101", "1e-100", ".5e2"]
    df = spark.createDataFrame([(t,) for t in tokens], "t string")
    keys = [r[0] for r in df.select(lit.scientific_key(F.col("t"))).collect()]
    assert keys == ["15e-4", "15e-4", "0e0", "+25e0", None, "1e-100", "5e1"]


def test_first_excess_is_the_first_by_position(spark):
    a, b = "7 3 3 9", "3 9 9"
    df = spark.createDataFrame([(a, b)], "a string, b string")
    inv = lambda c: ms.keyed(F.split(c, " "), lambda t: t)
    row = df.select(ms.first_excess(inv("a"), inv("b")), ms.first_excess(inv("b"), inv("a"))).first()
    assert tuple(row) == ("7", "9")


def test_identifier_boundaries(spark):
    text = "xBRCA1 BRCA1x _BRCA1 BRCA1. BRCA1.2 a/BRCA1 BRCA1는 TP53/KRAS12 IL-6"
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(tx.matches(F.col("t"), lit.IDENTIFIER)).first()[0] == ["BRCA1", "BRCA1", "IL-6"]


def test_parse_scopes_and_binding(spark):
    good = "[[DOC:a:table]]\n[[CELL:c1;0,0;1,1;header;]]\nDose\n[[/DOC]]"
    nested = "[[DOC:a:table]]\n[[DOC:b:paragraph]]\nx\n[[/DOC]]"
    note = "[[DOC:n:footnote]]\n[[NOTE:linked;a@c1,a]]\nx\n[[/DOC]]"
    rows = [(1, "source", good), (1, "draft", good), (2, "source", nested), (2, "draft", good), (3, "source", note), (3, "draft", "plain"), (4, "source", "p"), (4, "draft", "q")]
    texts = spark.createDataFrame(rows, "pair_id int, side string, text string")
    parsed, verdicts = scopes.parse_scopes(texts)
    bound, judged = scopes.scope_pairs(parsed, verdicts)
    assert {r.pair_id: r.binding for r in judged.collect()} == {1: "bound", 2: "unbound", 3: "unbound", 4: "plain"}
    assert sorted((r.key, r.source) for r in bound.collect()) == [("a|table|", ""), ("a|table|c1", "Dose")]
