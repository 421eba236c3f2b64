import os
import random

import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SF):
        pytest.skip("needs the given tables")
    return SF


@pytest.fixture(scope="session")
def make(spark):
    """Documents from texts or (id, text) pairs."""

    def build(texts, partitions=3):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        full = [(i, t, "en", f"src{(i or 0) % 3}", len(t or "")) for i, t in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(partitions)

    return build


@pytest.fixture(scope="session")
def edited():
    """Random texts in groups of edited copies."""

    def build(seed, groups, words=("ab", "cd", "Ef", "gh", "i", "j,", "k.", "é", "日本", "x1"), edits=3):
        rng = random.Random(seed)
        vocabulary = [a + b for a in words for b in words]
        texts = []
        for size in groups:
            base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 60))]
            for _ in range(size):
                copy = list(base)
                for _ in range(rng.randint(0, edits)):
                    copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
                texts.append(rng.choice([" ", "  ", "\n", "\t"]).join(copy))
        rng.shuffle(texts)
        return texts

    return build
