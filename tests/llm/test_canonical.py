from jobloom.llm.canonical import mapped

CATALOG = [(1, "Java", None), (2, "Java", "Spring Boot"), (3, "Go", None), (4, "APIs", "REST"), (5, "Contêineres", "Kubernetes"), (6, "C#", None), (7, "Dados", "Apache Spark"), (8, "SQL", None), (9, "SQL", "SQL Server"), (10, "NoSQL", "Redis")]
CASES = [
    ("Java", None, "x", None), ("Java", "Spring Boot", "x", None), ("Java ", None, "x", 1), ("JAVA (oo)", None, "x", 1), ("Java", "Sprnig Boot", "x", 2), ("Spring Boot", "Java", "x", 2),
    ("K8s", None, "x", 5), (None, "Kubernets básico", "x", 5), ("Rust", None, "x", 0), ("go", None, "x", 3), ("Csharp", None, "x", 6), ("conh. em Spark", None, "x", 7),
    (None, None, "Uso de SQL Server em produção", 9), (None, None, "Gestão de redes e de escala", 0), (None, None, "Projeto de redes locais", 0), (None, None, "Monitoração das redes", 0), (None, None, None, 0), ("", " ", "Domínio de Java", 1), ("SQL / similares", None, "x", 8), ("Ｊａｖａ", None, "x", 1),
]


def rows(spark, cases):
    return spark.createDataFrame([(i, "technical", s, u, r) for i, (s, u, r, _) in enumerate(cases)] + [(999, "education", None, None, "Java")], "requirement_id long, category string, skill string, subskill string, requirement string")


def test_cases(spark):
    catalog = spark.createDataFrame(CATALOG, "skill_id int, skill string, subskill string")
    r = rows(spark, CASES)
    got = {tuple(x) for x in mapped(spark, r.union(r.limit(3)), catalog).collect()}
    assert got == {(i, k) for i, (*_, k) in enumerate(CASES) if k is not None}
    assert mapped(spark, r.limit(0), catalog).count() == 0


def test_join_is_brute_force(spark):
    catalog = spark.createDataFrame(CATALOG, "skill_id int, skill string, subskill string")
    names = ["kubernetes", "springboot", "redis", "sqlserver", "apachespark", "java", "rest"]
    typed = {n[:i] + x + n[j:] for n in names for i in range(len(n) + 1) for j in (i, i + 1) for x in ("", "q", "zz") if n[:i] + x + n[j:]}
    mapped(spark, rows(spark, [(t, None, "x", 0) for t in sorted(typed)]), catalog).collect()
    got = {tuple(x) for x in spark.sql("SELECT gram, ref, d FROM jl_close").collect()}
    want = {tuple(x) for x in spark.sql("""
      SELECT gram, ref, levenshtein(gram, ref) AS d FROM (SELECT DISTINCT gram FROM jl_grams) CROSS JOIN jl_refs
      WHERE levenshtein(gram, ref) = 0 OR (levenshtein(gram, ref) = 1 AND (len > 4 OR (len = 4 AND length(gram) <> 4)))
        OR (levenshtein(gram, ref) = 2 AND (len > 7 OR (len > 4 AND array_sort(split(gram, '')) = array_sort(split(ref, '')))))""").collect()}
    assert got == want and len(got) > 100
