from jobloom.llm import names


def test_read_name():
    want = ("quelmira", "banco")
    for s in ("banco quelmira s/a", "quelmira (bco.)", "bancoquelmira ltda", "b. quelmira - matriz", "quelmira, banco s.a."):
        assert names.read_name(s) == want, s
    assert names.read_name("grupo ventura seguros")[1] == "seguros"
    assert names.read_name("grupo volufada")[1] == "grupo"


def test_distances():
    assert names.edit_distance("abcd", "abdc", 2) == 1 and names.edit_distance("a", "abcd", 2) == 3
    assert abs(names.jaro_winkler("martha", "marhta") - 0.9611) < 1e-3
    assert names.similar("rambededim", "rambeddeim", 0.86) and not names.similar("squad 1", "squad 2", 0.5)


def test_firms(spark):
    stored = spark.createDataFrame([("Banco Quelmira",), ("BQM",), ("Zilvutunio Capital",), ("Gestora Zilvutunio",), ("Dedallida Dados",), (None,)], "name string")
    typed = spark.createDataFrame(
        [("banco quelmria",), ("BQM S.A",), ("Zilvutunio",), ("ZILVUTUNIO CAP.",), ("Dealliida Dados Ltda",), ("-",), ("N/A",), (None,), ("",), ("Banco Quelmira",), ("Tessalux Seguros",), ("Tesalux Seg.",), ("Tessalux Cambio",), ("Morvantide Banco",)],
        "name string",
    )
    nick = spark.createDataFrame([("Banco Quelmira", "BQM")], "name_a string, name_b string")
    known = names.firms(stored, typed, nick)
    firm = {r.name: r.firm for r in known.collect()}
    # a firm known from typed names alone
    assert firm["Tessalux Seguros"] == firm["Tesalux Seg."] and "Tessalux Cambio" not in firm and "Morvantide Banco" not in firm
    pairs = {tuple(r) for r in names.same_firm_pairs(known).collect()}
    assert pairs == {tuple(sorted(p)) for p in (
        ("Banco Quelmira", "BQM"), ("Banco Quelmira", "banco quelmria"), ("BQM", "banco quelmria"), ("BQM", "BQM S.A"), ("BQM S.A", "Banco Quelmira"),
        ("Zilvutunio Capital", "ZILVUTUNIO CAP."), ("Dedallida Dados", "Dealliida Dados Ltda"),
    )}
    assert names.same_firm_pairs(names.firms(stored.limit(0), typed)).count() == 0
