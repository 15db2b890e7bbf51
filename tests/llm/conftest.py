import pytest

from regionpulse.session import get_session

DOCUMENT = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a documents table from texts (or (text, source) pairs), ids 0, 1, ..."""
    def make(texts, sources=None, ids=None, extra=""):
        ids = range(len(texts)) if ids is None else ids
        sources = ["s"] * len(texts) if sources is None else sources
        rows = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in zip(ids, texts, sources)]
        df = spark.createDataFrame(rows, DOCUMENT)
        return df.selectExpr("*", *([extra] if extra else []))
    return make


#: texts of the defined cases: null, empty, white space only, one word, repeated rows, non-Latin, very long
ODD_TEXTS = [None, "", " \n\t ", "word", "word", "\n\n", "a b", "ÀÉ 中文字 😀 é", "x" * 5000, "the cat sat " * 3000, "İΣ ﬁ \x1c   end", "!! ?? ##"]
