"""Fields of stored model replies: texts, usage, file citations and tool calls, read out of their JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANNOTATION = "struct<type:string,file_id:string,filename:string>"
CONTENT = f"struct<type:string,text:string,annotations:array<{ANNOTATION}>>"
ITEM = f"struct<id:string,type:string,status:string,queries:array<string>,content:array<{CONTENT}>>"
REPLY = f"struct<id:string,model:string,created_at:double,output:array<{ITEM}>,output_text:string,usage:struct<input_tokens:bigint,output_tokens:bigint,prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>>"


def _parsed(replies: DataFrame, id_col: str, reply_col: str) -> DataFrame:
    return replies.select(F.col(id_col), F.from_json(F.col(reply_col), REPLY).alias("r"))


def _parts() -> Column:
    """The text parts of all messages, in order."""
    messages = F.filter("r.output", lambda i: i["type"] == "message")
    parts = F.flatten(F.transform(messages, lambda m: F.coalesce(m["content"], F.array().cast(f"array<{CONTENT}>"))))
    return F.coalesce(F.filter(parts, lambda c: c["type"] == "output_text"), F.array().cast(f"array<{CONTENT}>"))


def fields(replies: DataFrame, id_col: str = "id", reply_col: str = "reply") -> DataFrame:
    """id, reply_id, model, created_at, texts, prompt_tokens, completion_tokens, total_tokens.

    texts has the parts of the messages in order, or the plain output text where no message has any. A reply that
    is no JSON, or null, gives a row with an empty texts and nulls.
    """
    said = F.filter(F.transform(_parts(), lambda c: c["text"]), lambda t: t.isNotNull())
    plain = F.when(F.col("r.output_text").isNotNull(), F.array("r.output_text")).otherwise(F.array().cast("array<string>"))
    use = F.col("r.usage")
    return _parsed(replies, id_col, reply_col).select(
        id_col, F.col("r.id").alias("reply_id"), "r.model", "r.created_at", F.when(F.size(said) > 0, said).otherwise(plain).alias("texts"),
        F.coalesce(use["prompt_tokens"], use["input_tokens"]).alias("prompt_tokens"), F.coalesce(use["completion_tokens"], use["output_tokens"]).alias("completion_tokens"), use["total_tokens"].alias("total_tokens"),
    )


def citations(replies: DataFrame, id_col: str = "id", reply_col: str = "reply") -> DataFrame:
    """id, part, place, file_id, filename: one row for each file citation of each text part, both counted from 0."""
    rows = _parsed(replies, id_col, reply_col).select(id_col, F.posexplode(_parts()).alias("part", "c"))
    each = rows.select(id_col, "part", F.posexplode("c.annotations").alias("place", "a"))
    return each.filter(F.col("a.type") == "file_citation").select(id_col, "part", "place", "a.file_id", "a.filename")


def tool_calls(replies: DataFrame, id_col: str = "id", reply_col: str = "reply") -> DataFrame:
    """id, place, call_id, type, status, queries: the items of a reply that are calls of a tool."""
    rows = _parsed(replies, id_col, reply_col).select(id_col, F.posexplode("r.output").alias("place", "i"))
    return rows.filter(F.col("i.type").endswith("_call")).select(id_col, "place", F.col("i.id").alias("call_id"), "i.type", "i.status", "i.queries")
