"""The test tables as facts."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .sources import Relation, RelationSource

#: Relation: table, key, members, references, collections.
TABLES = {
    "region": ("region", "r_regionkey", {"name": "r_name"}, {}, {}),
    "nation": ("nation", "n_nationkey", {"name": "n_name", "region": "n_regionkey"}, {"region": "region"}, {}),
    "customer": ("customer", "c_custkey", {"key": "c_custkey", "name": "c_name", "nation": "c_nationkey", "balance": "c_acctbal", "segment": "c_mktsegment"}, {"nation": "nation"}, {}),
    "supplier": ("supplier", "s_suppkey", {"key": "s_suppkey", "name": "s_name", "nation": "s_nationkey", "balance": "s_acctbal"}, {"nation": "nation"}, {}),
    "part": ("part", "p_partkey", {"key": "p_partkey", "name": "p_name", "brand": "p_brand", "type": "p_type", "size": "p_size", "price": "p_retailprice"}, {}, {}),
    "order": ("orders", "o_orderkey", {"key": "o_orderkey", "customer": "o_custkey", "status": "o_orderstatus", "total": "o_totalprice", "priority": "o_orderpriority"}, {"customer": "customer"}, {}),
    "lineitem": ("lineitem", None, {"order": "l_orderkey", "part": "l_partkey", "supplier": "l_suppkey", "number": "l_linenumber", "quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "flag": "l_returnflag", "ship": "l_shipdate"}, {"order": "order", "part": "part", "supplier": "supplier"}, {}),
    "event": ("events", "event_id", {"key": "event_id", "user": "user_id", "type": "event_type", "value": "value"}, {}, {}),
    "doc": ("documents", "doc_id", {"key": "doc_id", "text": "text", "lang": "lang", "source": "source", "size": "n_chars"}, {}, {}),
    "label": ("labels", "doc_id", {"doc": "doc_id", "quality": "quality", "toxic": "toxic"}, {"doc": "doc"}, {}),
    "turn": ("conversations", ["conv_id", "turn"], {"conversation": "conv_id", "number": "turn", "role": "role"}, {}, {}),
    "vec": ("embeddings", "vec_id", {"key": "vec_id", "label": "label"}, {}, {"embedding": "embedding"}),
    "page": ("pages", "page_id", {"key": "page_id", "url": "url"}, {}, {}),
    "bench": ("benchmark", "item_id", {"key": "item_id", "text": "text"}, {}, {}),
}


def tables(spark: SparkSession, sf_dir: str, *names: str) -> RelationSource:
    """A source over the named relations (all: none named); only their columns in use are ever read."""
    return RelationSource([Relation(n, spark.read.parquet(f"{sf_dir}/{t}.parquet"), key, dict(columns), dict(refs), dict(arrays)) for n in names or TABLES for t, key, columns, refs, arrays in [TABLES[n]]])
