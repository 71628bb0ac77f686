import pytest

SF = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor " * 20_000


@pytest.fixture(scope="session")
def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def odd(documents):
    """Nulls, empty, very long and repeated rows, ties, and ids that are null or given twice."""
    d = documents
    return [
        *d[:60], d[3], d[3], (3, d[5][1]), (None, d[7][1]), (None, d[7][1]), (None, None), (9001, None), (9002, ""),
        (9003, " \n\t "), (9004, "x" * 5000), (9005, "one two"), (9006, LONG), (9007, LONG + "end"),
        (9008, "a\n\nb\na\n b\na " + "é😀ü " * 15), (9009, "AKIA" + "Z" * 20 + ' Token = "abc=def" password=token:abcdefgh'),
        (9010, "ſecret=abcdefgh paSSwd :'ab.cd/ef' api_KEY=" + "0f" * 20 + " AKIAAKIA AKIA" + "9" * 16),
    ]


@pytest.fixture(scope="session")
def frame(spark):
    """Documents with further columns, some of whose names clash with those of the operators."""

    def build(rows):
        wide = [(i, t, "en", "src0", 5, [1], 2, "x") for i, t in rows]
        return spark.createDataFrame(
            wide, "doc_id long, text string, lang string, source string, n_chars long, spans array<int>, rid int, h string"
        )

    return build
