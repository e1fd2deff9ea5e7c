from pyspark.sql import functions as F

from jobloom.llm.openings import interleaved, with_opening


def test_titles(spark):
    want = ("anl de testes", "junior", "cadastro tribo ipe")
    forms = ["Analista de Testes Júnior - Cadastro Tribo Ipê", "A‍NL.⁠ DE TESTES JR. - CADASTRO TRIBO IPÊ (CÓD. ‌2940)", "Cadastro Tribo Ipê: Anl. de Testes Jr #12",
             "Analista de Testes (Cadastro Tribo Ipê) Jr.", "Analista de Testes Júnior | Cadastro Tribo Ipê", "Analista de Testes Juniro - Cadastro Tribo Ipe 2º turno"]
    df = with_opening(spark.createDataFrame([(t, None) for t in forms], "t string, l string"), "t", "l").select("role", "level", "team")
    assert {tuple(r) for r in df.collect()} == {want}
    rows = [("Backend Developer Mid-level - Boletos Squad 2", "x"), (None, None), ("", "")]
    r = with_opening(spark.createDataFrame(rows, "t string, l string"), "t", "l").select("role", "level", "team").collect()
    assert tuple(r[0]) == ("backend dev", "midlevel", "boletos squad 2") and r[1].role is None and r[2].role == ""


def test_cities(spark):
    forms = {"São Paulo, SP": "sao paulo", "SP - Santo André": "santo andre", "Sao Paulo SP": "sao paulo", "Ｓãｏ Paulo/SP": "sao paulo", "Natal, RN, Brasil": "natal",
             "Natal (RN)": "natal", "Recife - PE (Híbrido)": "recife", "東京": "東京", "": "", None: ""}
    df = with_opening(spark.createDataFrame([(t, "", t) for t in forms], "t string, title string, l string"), "title", "l")
    assert {r.t: r.city for r in df.collect()} == forms


def test_interleaved(spark):
    r = spark.createDataFrame([("a b c", "x y")], "a string, b string").select(interleaved(F.col("a"), F.col("b")).alias("x")).first()
    assert r.x == "a x b y c"
