"""Classes and word boundaries are those of the SQL: ASCII only, whatever stands beside a match."""

import re

import duckdb
import pytest

from oracle import TABLES, of_spark, rows
from textward import catalog
from textward.functions.spans import java, python
from textward.sources import catalogs as C

BESIDE = ["ódlabcde en", "taque ezódlabcdef, x", "DL abcdeé", "é12345", "12345ñ x", "12 Main Stéphane", "ß123-45-6789É", "x é@y.co éa.b@c.com", "٣٤٥-٦٧-٨٩٠١ ٣٣٣٣٣", "12345\x0b12 Main\xa0St", "acct\u200912345678", "dob: 1/2/1990ü", "passport: X123456ä", "plain", "", None]


@pytest.fixture(scope="module")
def beside(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("beside"))
    docs = [(i, t, ["fr", "es", "de"][i % 3], f"src{i % 2}", len(t or "")) for i, t in enumerate(BESIDE)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{at}/documents.parquet")
    return at


def of_sql(name, at):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '" + (f"{at}/documents.parquet/*.parquet'" if t == "documents" else f"/root/testdata/sf0.001/{t}.parquet'"))
    cur = c.execute(catalog.oracle_sql()[name])
    return rows([x[0] for x in cur.description], cur.fetchall())


@pytest.mark.parametrize("name", ["merged_profile", "pii_redact_full", "pii_redact_hash", "pii_redact_partial", "sql_lateral_findings"])
def test_letters_beside_a_match(spark, beside, name):
    assert of_spark(catalog.queries()[name](spark, beside)) == of_sql(name, beside)


def test_classes_are_spelt_out():
    assert python(r"(?i)\bdl[:\s#]*[\w]\\d\D[]\d]\B") == r"(?i)(?a:\b)dl[:\t\n\f\r\x20#]*[0-9A-Za-z_]\\d[^0-9][]0-9](?a:\B)"
    assert java(r"(?i)\d", unicode=True) == r"(?idU)\d" and java(r"(?i)\d") == "(?idu)[0-9]"
    for p in (r[1] for rows_ in (C.PII, C.CODE, C.SECRETS) for r in rows_):
        re.compile(python(p))
