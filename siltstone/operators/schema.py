"""The row that extraction gives, and conversions of metadata."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

VALUE = "struct<tag:string,text:string,number:bigint,float:double,datetime:timestamp,boolean:boolean,list:array<string>>"
PARSED = f"struct<text:string,metadata:map<string,{VALUE}>,error:struct<kind:string,message:string>>"


def tagged(value) -> dict:
    """A metadata value as the union that a column can hold."""
    out = dict.fromkeys(("tag", "text", "number", "float", "datetime", "boolean", "list"))
    for kind, name in ((bool, "boolean"), (int, "number"), (float, "float"), (str, "text"), (list, "list"), (datetime.datetime, "datetime")):
        if isinstance(value, kind):
            return out | {"tag": name, name: value}
    return out | {"tag": "text", "text": str(value)}


def get(metadata: Column, key: str, kind: str = "text") -> Column:
    """A value of a kind; null if the key is missing or its value of another kind."""
    v = F.try_element_at(metadata, F.lit(key))
    return F.when(v["tag"] == kind, v[kind])


def shown(v: Column) -> Column:
    """A metadata value as text: lists in brackets, times by RFC 3339."""
    return (
        F.when(v["tag"] == "text", v["text"]).when(v["tag"] == "number", v["number"].cast("string")).when(v["tag"] == "float", v["float"].cast("string"))
        .when(v["tag"] == "boolean", v["boolean"].cast("string")).when(v["tag"] == "datetime", F.date_format(v["datetime"], "yyyy-MM-dd'T'HH:mm:ssxxx"))
        .otherwise(F.concat(F.lit("["), F.array_join(v["list"], ", "), F.lit("]")))
    )
