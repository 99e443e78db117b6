"""The queries of this package against their SQL: on the smallest tables, and on a table of odd texts."""

import os
import random
from pathlib import Path

import duckdb
import pytest

from cairnlake.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def compare(spark, folder, name):
    duck = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        duck.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    df = QUERIES[name](spark, str(folder))
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    said = duck.sql(ORACLES[name])
    assert sorted(said.columns) == columns
    at = [said.columns.index(c) for c in columns]
    assert got == sorted((tuple(r[i] for i in at) for r in said.fetchall()), key=str)
    return got


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the sample tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    assert compare(spark, DATA, name)


def iban(rng):
    country, n = rng.choice([("DE", 22), ("ES", 24), ("GB", 22), ("NO", 15), ("XX", 20)])
    body = "".join(rng.choices("0123456789" + "ABCXYZ" * (country == "GB"), k=n - 4))
    number = int("".join(str(int(c, 36)) for c in body + country + "00"))
    check = 98 - number % 97 + rng.choice([0, 0, 0, 1])
    plain = f"{country}{check:02}{body}"
    return rng.choice([plain, " ".join(plain[i : i + 4] for i in range(0, n, 4))])


@pytest.fixture(scope="module")
def odd_texts(spark, tmp_path_factory):
    rng = random.Random(11)
    said = "the account IBAN konto ssn SSN, social security is password= token: secret example sample mail host ip card +49 visa call AND THE É x_".split(" ")
    made = lambda: rng.choice([
        iban(rng), f"{rng.randint(0, 999):03}-{rng.randint(0, 99):02}-{rng.choice([0, 12, 6789]):04}", "".join(rng.choices("0123456789abcdef", k=rng.randint(14, 40))),
        "AKIA" + "".join(rng.choices("ABCXYZ", k=rng.randint(15, 17))), "a@b.c", "1.2.3.4", "4111 1111 1111 1111", "+1 (22) 555-1234", *said,
    ])
    texts = [rng.choice([" ", " ", "\n", ""]).join(made() for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    rows = list(enumerate(texts)) + [(None, "null id"), (7, None), (3, texts[3])]
    folder = tmp_path_factory.mktemp("odd")
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(folder / "documents.parquet"))
    return folder


def test_odd_texts(spark, odd_texts):
    found = compare(spark, odd_texts, "op1_pii")
    columns = sorted(QUERIES["op1_pii"](spark, str(odd_texts)).columns)
    for c in ("n_iban", "n_ssn", "n_credential", "n_email", "n_ip", "n_card", "n_phone"):
        assert sum(r[columns.index(c)] for r in found) > 30, c
    compare(spark, odd_texts, "op6_quality")
