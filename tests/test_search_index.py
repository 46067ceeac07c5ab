"""Stored postings: the same hits as reading all documents, and only the buckets of a query are read."""

import pytest
from pyspark.sql import functions as F

from opsloom.operators import search
from opsloom.session import fresh_dir

ROWS = [(1, "red apple pie", "apples and pears"), (2, "apply here", "a rad pie"), (3, "ape", None), (4, None, "p"),
        (5, "pear", "xyz apple red"), (6, "éclair", "eclair"), (7, "aple appple appl", ""), (8, "re", "rd red read")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "id LONG, title STRING, summary STRING").repartition(3)


@pytest.fixture(scope="module")
def index(spark, docs):
    return search.build_index(docs, fresh_dir(spark, "index"), buckets=32)


@pytest.mark.parametrize("query", ["apple", "red apple", "re", "rad pei", "eclair", "p", "zzz", "apple-pie red"])
@pytest.mark.parametrize("kept", [None, "id > 2"])
def test_same_hits_as_without_index(docs, index, query, kept):
    cols = ["id", "words", "typos", "proximity", "attribute", "exact"]
    with_index = search.search(docs, query, kept, index=index).select(*cols).collect()
    assert with_index == search.search(docs, query, kept).select(*cols).collect()


def test_terms_are_those_within_one_edit(index):
    near = {r.term: r.typos for r in index.terms(["apple"]).collect()}
    assert near == {"apple": 0, "apples": 1, "apply": 1, "aple": 1, "appple": 1, "appl": 1}
    assert {r.term for r in index.terms(["re"]).collect()} == {"re"}


def test_a_query_reads_the_buckets_of_its_terms_only(index, docs):
    terms = [r.term for r in index.terms(["apple"]).collect()]
    rows = index.read("postings", "term", terms)
    assert {r.term for r in rows.select("term").distinct().collect()} == set(terms)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert len(rows.inputFiles()) > 0
    read = {f.split("bucket=")[1].split("/")[0] for f in rows.select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}
    assert len(read) <= len(terms)
