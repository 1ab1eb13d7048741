import pytest

def mirrored(n, flip=False):
    """The Thue-Morse word of ``n`` letters (a power of two) or its mirror: pairs that meet modulo any power of two."""
    return "".join("ab"[(k.bit_count() + flip) % 2] for k in range(n))


LONG = "lorem ipsum dolor sit amet " * 4000


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, blank and very long texts, ties, repeated rows, repeated ids, and columns that clash with inner names."""
    texts = [
        (5, "the cat sat on the mat and looked at the other cat for a long while today"),
        (1, "the cat sat on the mat and looked at the other cat for a long while today"),
        (1, "the cat sat on the mat and looked at the other cat for a long while today"),
        (1, "another text under the same id"),
        (None, "the cat sat on the mat and looked at the other cat for a long while today"),
        (None, None),
        (2, None),
        (3, ""),
        (4, " \t\n\x0b "),
        (6, "one"),
        (7, "One"),
        (8, LONG),
        (9, LONG + "end"),
        (10, "A line that repeats here\n a LINE that repeats here \nshort\nshort"),
        (11, "a line that repeats here\nmore <|endoftext|> text"),
        (12, "日本語 \x1c ½ é ́ 😀 don't"),
        (13, "x " * 300),
        (14, "##### $$$$$ %%%%% &&&&& ||||| <<<<< >>>>> ***** ##### $$$$$ %%%%% &&&&&"),
        (15, mirrored(2048)),
        (16, mirrored(2048, flip=True)),
        (17, "alpha beta gamma delta " + mirrored(1024)),
        (18, "alpha beta gamma delta " + mirrored(1024, flip=True)),
    ]
    rows = [(i, t, "k", 1, 2, 3, 4.0, True, "s", None) for i, t in texts]
    names = "doc_id bigint, text string, key string, kind int, n int, code int, score double, kept boolean, line string, component_id string"
    return spark.createDataFrame(rows, names)


@pytest.fixture(scope="session")
def mirrors():
    return mirrored(2048), mirrored(2048, flip=True)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark, tmp_path_factory):
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
