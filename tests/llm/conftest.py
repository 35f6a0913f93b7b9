import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size string, kept int, key string, id int, n int, row string, doc string, tag int, spans int, score string"
WORDS = ["alpha", "beta", "gamma", "delta", "wörter", "été", "niño", "x1", "the", "of", "and", "stone", "river", "cloud"]


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(n))


def edge_rows() -> list[tuple]:
    """Documents with nulls, empty and long texts, copies, near copies, repeated rows and odd sources."""
    rng = random.Random(7)
    base = sentence(rng, 80)
    texts = [None, "", " \n\t ", "one", "tiny text here", base, base, base.replace(" ", "\n", 3), base + " extra", "prefix " + base, sentence(rng, 60), "İstanbul ŞÇ 日本語 😀 " + sentence(rng, 20), sentence(rng, 4000)]
    texts += [sentence(rng, rng.randint(1, 60)) for _ in range(20)]
    rows = [(i * 3, t, "en", None if i % 7 == 0 else f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, "a document without an id " + sentence(rng, 9), None, "s1", None), (None, None, None, None, None), (3, "another text under an id that is taken " + sentence(rng, 9), "en", "s0", 1)]
    return [(*r, "big", 1, "k", 9, 9, "r", "d", 4, 5, "s") for r in rows]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), COLUMNS).coalesce(2)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)


EMBEDDING = "vec_id long, embedding array<float>, label int, n long, key string, cell int, own string, size int"
NAN, INF = float("nan"), float("inf")


def vector_rows() -> list[tuple]:
    """Vectors with nulls, zeros, odd components and lengths, copies, repeated rows and missing labels."""
    a, b, near = [1.0, 2.0, 3.0], [3.0, -1.0, 0.5], [1.01, 2.0, 3.0]
    vectors = [(0, a, 1), (1, a, 1), (2, near, 1), (3, b, 1), (4, a, 2), (5, None, 1), (6, [], 1), (7, [0.0, 0.0, 0.0], 1), (8, [1.0, None, 3.0], 1), (9, [NAN, 2.0, 3.0], 1), (10, [INF, 2.0, 3.0], 1)]
    vectors += [(11, a, None), (12, [2.0, 4.0, 6.0], 1), (13, [1.0, 2.0], 1), (14, [1e-30, 2e-30, 3e-30], 1), (15, [1e30, 2e30, 3e30], 1), (None, near, 1), (16, b, 3), (16, b, 3), (17, [-1.0, -2.0, -3.0], 1)]
    return [(*v, 7, "k", 3, "o", 2) for v in vectors]


@pytest.fixture(scope="session")
def edge_dir(spark, edge, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("edge"))
    edge.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(3, 1, 0), (9, 1, 1), (9, 0, 0), (None, 1, 1), (12, 0, None), (30, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(vector_rows(), EMBEDDING).write.parquet(f"{d}/embeddings.parquet")
    return d


@pytest.fixture(scope="session")
def empty_dir(spark, nothing, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    nothing.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], EMBEDDING).write.parquet(f"{d}/embeddings.parquet")
    return d
