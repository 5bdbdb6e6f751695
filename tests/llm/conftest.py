import pytest
from pyspark.sql import functions as F

WORDS_EN = "the house stands near a river and many people walk there every morning with their dogs before work".split()
WORDS_DE = "das haus steht am fluss und viele leute gehen dort jeden morgen mit ihren hunden vor der arbeit".split()


def sentence(words, i, n=14):
    return " ".join(words[(i * 7 + j * (1 + i % 5)) % len(words)] for j in range(n))


def sample_documents():
    rows = []
    for i in range(24):
        words, lang = (WORDS_EN, "en") if i % 2 else (WORDS_DE, "de")
        text = ". ".join(sentence(words, i * 3 + s) for s in range(4))
        rows.append((i, text, lang, f"s{i % 3}"))
    base = " ".join(f"word{j}" for j in range(120))
    rows += [(100, base, "en", "s0"), (101, base + " tail", "en", "s1"), (102, base, "en", None),
             (103, None, "en", "s0"), (104, "", "de", "s1"), (105, "12 34 !!", None, "s2"),
             (106, "ok", "en", "s2"), (106, "ok", "en", "s2"), (None, "text without an id", "en", "s0"),
             (107, "x" * 50_000 + " " + "y " * 3000, "en", "s1"),
             (108, "mail a.b@c.org or 10.0.0.1 or 4111 1111 1111 1111 or +1 (212) 555-0100", "en", "s2"),
             (109, "at +1 (212) 555-0100 4111111111111111", "en", "s2")]
    return rows


def write_tables(spark, path, empty=False):
    """Small tables with extra columns whose names the operators use inside."""
    keep = 0 if empty else 10_000
    docs = spark.createDataFrame(sample_documents(), "doc_id long, text string, lang string, source string").limit(keep)
    extra = ["size", "score", "lang_pred", "key", "th", "b", "h", "copies", "pattern", "task", "words", "t", "v",
             "spans", "left", "rank", "id", "row", "taken", "sources", "u"]
    docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    for c in extra:
        docs = docs.withColumn(c, F.lit(c))
    docs.coalesce(2).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, 1 if i % 4 == 1 else 0) for i in range(24)] + [(103, 0, 1), (None, 0, 1), (5, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").limit(keep) \
        .withColumn("text", F.lit("clash")).write.parquet(f"{path}/labels.parquet")
    vecs = [(i, [float((i * j) % 7) / 16 for j in range(5)]) for i in range(120)]
    vecs += [(200, None), (201, [1.0, None]), (202, [float("nan")]), (250, [0.5, 0.25]), (250, [0.5, 0.25]), (300, [])]
    spark.createDataFrame(vecs, "vec_id long, embedding array<float>").limit(keep) \
        .withColumn("score", F.lit(1)).withColumn("id", F.lit("x")) \
        .withColumn("label", F.when(F.col("vec_id") % 5 < 4, (F.col("vec_id") % 5).cast("int"))).write.parquet(f"{path}/embeddings.parquet")
    urls = ["http://a.example.net/en/x", "https://Example.NET/EN/x", "https://example.com/de/?q", "http://x.org/fr/",
            "http://net/", "http://foo.net", "no url", None, "", "ftp://b.org/fr", "http://notexample.com/de/",
            "http://a.com/b.net/x", "http://h.net/" + "p" * 5000]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").limit(keep) \
        .withColumn("host", F.lit("clash")).withColumn("rule", F.lit(3)).write.parquet(f"{path}/pages.parquet")
    return str(path)


@pytest.fixture(scope="session")
def tiny(spark, tmp_path_factory):
    return write_tables(spark, tmp_path_factory.mktemp("tiny"))


@pytest.fixture(scope="session")
def nothing(spark, tmp_path_factory):
    return write_tables(spark, tmp_path_factory.mktemp("nothing"), empty=True)
