"""The registered queries on the small tables: column names and types of each
contract, and values where SQL or brute force can say them."""
import hashlib

import public_tokenizers as P
import pytest
import tiktoken

import __spark_entry__ as E
from oracle_check import compare, duck
from quizlens.llm import queries as Q
from .test_jaccard import brute

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": [("doc_id", "bigint"), ("keep_id", "bigint"), ("group_size", "bigint"), ("kept", "boolean"), ("text_sha256", "string")],
    "op2": [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")],
    "op3": [("conv_id", "bigint"), ("turn", "bigint"), ("role", "string"), ("text", "string"), ("parent", "bigint"),
            ("root", "bigint"), ("depth", "bigint")],
    "op4": [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")],
    "op5": [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")],
    "op6": [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint")],
    "op7": [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")],
    "op8": [("page_id", "bigint"), ("host", "string"), ("path", "string"), ("rule", "string"), ("verdict", "string")],
    "op9": [("doc_id", "bigint"), ("size", "bigint"), ("source_size", "bigint"), ("target", "double"), ("taken", "bigint")],
    "op10": [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")],
    "op11": [("doc_id", "bigint"), ("n_a", "bigint"), ("n_b", "bigint"), ("n_groups", "bigint"), ("n_links", "bigint"),
             ("n_best", "bigint"), ("count_sum", "bigint"), ("groups_sha256", "string")],
    "op12": [("doc_id", "bigint"), ("size", "bigint"), ("text_crc32", "bigint"), ("law", "string"), ("shard", "int"),
             ("slot", "bigint"), ("grown_shard", "int")],
    "op13": [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"),
             ("rank", "int")],
}
BY_N = {k.split("_")[0]: k for k in Q.QUERIES}


def test_all_are_registered_once():
    assert sorted(BY_N) == sorted(COLUMNS) and len(Q.QUERIES) == 13
    assert set(Q.QUERIES) | {"pipeline"} <= set(E.queries())
    assert set(Q.ORACLE) <= set(Q.QUERIES)


@pytest.mark.parametrize("n", sorted(COLUMNS))
def test_columns(spark, n):
    df = Q.QUERIES[BY_N[n]](spark, SF)
    assert df.dtypes == COLUMNS[n]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_equals_sql(spark, name):
    found = compare(spark, duck(SF), name, Q.QUERIES[name], Q.ORACLE[name], SF)
    assert found["ok"], found


def test_op6_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = Q.QUERIES[BY_N["op6"]](spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)


def test_op7_equals_library(spark):
    from quizlens.llm.bpe import vocabulary
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, special_tokens={},
                            mergeable_ranks=vocabulary(P.path("byte_bpe_50k.tiktoken")).ranks)
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = enc.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(),
                          hashlib.sha256((r.text or "").encode()).hexdigest())
    got = {r.doc_id: tuple(r)[1:] for r in Q.QUERIES[BY_N["op7"]](spark, SF).collect()}
    assert got == want


def test_op5_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [r for r in Q.QUERIES[BY_N["op5"]](spark, sf).collect() if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def test_op10_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(r.predicted, toxic[r.doc_id]) for r in Q.QUERIES[BY_N["op10"]](spark, sf).collect()
            if r.held_out and r.doc_id in toxic]
    hit = held.count((1, 1))
    assert hit >= 0.95 * (hit + held.count((1, 0))) and hit >= 0.85 * (hit + held.count((0, 1)))
