import unicodedata

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from jobloom.llm.plain_form import changed_values, compose, plain_array, plain_columns, slices, tables

CASES = {
    "Ｓãｏ Paulo － SP": "São Paulo - SP",
    "Belo Hori﻿z​ont\xade, MG": "Belo Horizonte, MG",
    "Rесіfе, РЕ": "Recife, PE",
    "Київ": "Київ", "София": "София", "Αθήνα": "Αθήνα", "東京": "東京",
    "Criciúma": "Criciúma", "Educação": "Educação",
    "👩‍💻 Dados": "👩‍💻 Dados", "certiﬁcação": "certificação", "Backoﬃce": "Backoffice",
    "1ª turma™ 2º": "1ª turma™ 2º", "Engenheiro(а)": "Engenheiro(a)", "": "", "João – II": "João – II",
    "Κanban": "Kanban", "a−b": "a-b",
}


def test_cases():
    assert plain_array(pa.array([*CASES, None])).to_pylist() == [*CASES.values(), None]


def test_sliced_and_empty():
    a = pa.array(["x", "Ｓãｏ", None, "ok"])
    assert plain_array(a[1:]).to_pylist() == ["São", None, "ok"]
    assert plain_array(pa.array([], pa.string())).to_pylist() == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("aeocnAEçãú ̧̣́̂̃각가"), max_size=12)))
def test_compose_is_nfc(texts):
    cps = np.array([ord(c) for s in texts for c in s], np.uint32)
    row = np.array([i for i, s in enumerate(texts) for _ in s], np.int64)
    # precomposed letters are taken apart first, as composition alone doesn't reorder across them
    texts = [unicodedata.normalize("NFD", s) for s in texts]
    cps = np.array([ord(c) for s in texts for c in s], np.uint32)
    row = np.array([i for i, s in enumerate(texts) for _ in s], np.int64)
    out, own = compose(cps, row, tables())
    got = ["".join(map(chr, out[own == i])) for i in range(len(texts))]
    assert got == [unicodedata.normalize("NFC", s) for s in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=20)))
def test_idempotent(texts):
    once = plain_array(pa.array(texts, pa.string()))
    assert plain_array(once).to_pylist() == once.to_pylist()


def test_slices():
    a = pa.array(["x" * 5, None, "y" * 50, "", "z"])
    assert slices(a, 10) == [(0, 2), (2, 3), (3, 5)] and slices(a[:0]) == [] and slices(a[1:], 1000) == [(0, 4)]


def test_columns(spark):
    df = spark.createDataFrame([(1, "Ｓão", "x"), (2, None, ""), (1, "Ｓão", "x")], "id long, title string, n string")
    out = plain_columns(df, ["title"]).collect()
    assert sorted((r.id, r.title_plain or "", r.title_changed) for r in out) == [(1, "São", True), (1, "São", True), (2, "", False)]
    assert {tuple(r) for r in changed_values(df, "id", ["title"]).collect()} == {("title", 1)}
    assert changed_values(df.limit(0), "id", ["title"]).count() == 0
