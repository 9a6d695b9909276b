"""What inscriptions carry: media classes, titles, properties, small JSON actions, and runestones to be written."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerweave.functions import codecs
from ledgerweave.functions.actions import field

#: Content types by the way they are shown. All others are unknown.
MEDIA = {
    "audio": ["audio/flac", "audio/mpeg", "audio/wav"],
    "code": ["application/json", "application/x-javascript", "application/yaml", "text/css", "text/javascript", "text/x-python"],
    "font": ["font/otf", "font/ttf", "font/woff", "font/woff2"],
    "iframe": ["image/svg+xml", "text/html", "text/html;charset=utf-8"],
    "image": ["image/apng", "image/avif", "image/gif", "image/jpeg", "image/jxl", "image/png", "image/webp"],
    "markdown": ["text/markdown", "text/markdown;charset=utf-8"],
    "model": ["model/gltf+json", "model/gltf-binary"],
    "pdf": ["application/pdf"],
    "text": ["application/pgp-signature", "text/plain", "text/plain;charset=utf-8"],
    "video": ["video/mp4", "video/webm"],
}
#: Keys of metadata, in any case, that hold each part.
METADATA_KEYS = {"title": ("title", "collection", "collection title"), "author": ("author", "creator", "artist"), "description": ("description",)}


def media_class(content_type: Column, content: Column) -> Column:
    """How a content is shown; unknown where it is empty or its type isn't listed."""
    shown = F.coalesce(*(F.when(content_type.isin(types), F.lit(name)) for name, types in MEDIA.items()), F.lit("unknown"))
    return F.when(F.coalesce(F.octet_length(content), F.lit(0)) == 0, "unknown").otherwise(shown)


def domain_action(body: Column) -> Column:
    """struct(p, op, name) of a name action in JSON, the name trimmed; null for what isn't a JSON object."""
    made = F.struct(field(body, "p").alias("p"), field(body, "op").alias("op"), F.trim(F.coalesce(field(body, "name"), F.lit(""))).alias("name"))
    return F.when(F.get_json_object(body, "$").startswith("{"), made)


def ranges_of(body: Column) -> Column:
    """array<struct(start, size)> of a JSON list of ranges; null if it is malformed."""
    return F.from_json(body, "array<struct<start:bigint,size:bigint>>")


def stake_asset(height: Column, mainnet: bool = True) -> Column:
    """struct(name, amount) of the asset that a node has to hold at a height."""
    before, later, switch, amount = ("ordx:f:pearl", "ordx:f:pearl", 942_000, 1_000_000) if mainnet else ("ordx:f:dogcoin", "ordx:f:rarepizza", 128_000, 1_000)
    return F.struct(F.when(height < switch, before).otherwise(later).alias("name"), F.lit(amount).cast("bigint").alias("amount"))


def _text_value(value) -> str:
    if isinstance(value, dict):
        value = next((v for k, v in value.items() if isinstance(k, str) and k.lower() == "name"), "")
    return value if isinstance(value, str) else ""


def titles_of(data: bytes) -> dict[str, str]:
    """title, author and description of CBOR metadata: a text is a title, a map is searched by key; empty texts where there is none.

    A value may be a map with a name. The first matching key in the order of the map counts.
    """
    empty = dict.fromkeys(METADATA_KEYS, "")
    try:
        value, _ = codecs.read_cbor(data)
    except (ValueError, IndexError, TypeError):
        return empty
    if isinstance(value, str):
        return empty | {"title": value}
    if not isinstance(value, dict):
        return empty
    return {part: next((_text_value(v) for k, v in value.items() if isinstance(k, str) and k.lower() in keys), "") for part, keys in METADATA_KEYS.items()}


def properties_of(data: bytes) -> dict | None:
    """A gallery's items (inscription id, index, title) and its title, from CBOR maps with small integers as keys; None if malformed."""
    try:
        value, _ = codecs.read_cbor(data)
        title = lambda v: (v or {}).get(0)
        items = [{"id": codecs.inscription_id(i[0]) if i.get(0) else None, "index": i.get(2, 0), "title": title(i.get(1))} for i in value.get(0, [])]
        return {"title": title(value.get(1)), "items": items}
    except (ValueError, IndexError, TypeError, AttributeError):
        return None


def titles(metadata: Column) -> Column:
    return codecs._struct_udf(titles_of, "title:string,author:string,description:string")(metadata)


def properties(data: Column) -> Column:
    return codecs._struct_udf(properties_of, "title:string,items:array<struct<id:string,index:bigint,title:string>>")(data)


def _cbor_head(kind: int, n: int) -> bytes:
    for width, mark in ((0, None), (1, 24), (2, 25), (4, 26), (8, 27)):
        if width == 0 and n < 24:
            return bytes([kind << 5 | n])
        if width and n < 1 << 8 * width:
            return bytes([kind << 5 | mark]) + n.to_bytes(width, "big")
    raise ValueError("too long")


def write_cbor(texts: dict[str, str]) -> bytes:
    """A map of texts in CBOR, keys in the order that they have."""
    out = _cbor_head(5, len(texts))
    for pair in texts.items():
        for part in pair:
            raw = part.encode()
            out += _cbor_head(3, len(raw)) + raw
    return out


def json_as_cbor(body: Column) -> Column:
    """A JSON object of texts as CBOR; null for all else."""

    def one(text):
        try:
            value = json.loads(text)
        except (ValueError, TypeError):
            return None
        return write_cbor(value) if isinstance(value, dict) and all(isinstance(v, str) for v in value.values()) else None

    def run(values: pd.Series) -> pd.Series:
        return pd.Series([one(v) for v in values], dtype=object)

    return F.pandas_udf(run, "binary")(body)


#: What a runestone's script can hold, without its first two bytes.
MOST_PAYLOAD = 78


def encipher(stone: dict) -> bytes | None:
    """The output script of a runestone: the inverse of codecs.decipher, with the same names of fields; None if it is too long.

    Fields that are None are left out, those of an etching without one too, and those of terms likewise. Edicts are written in
    the order of their ids, as differences.
    """
    tags, out = codecs.RUNE_TAGS, []
    get = lambda n: stone.get(n)
    if get("etching"):
        out += [tags["flags"], 1 | bool(get("terms")) << 1 | bool(get("turbo")) << 2]
        names = ["rune", "divisibility", "spacers", "symbol", "premine"]
        if get("terms"):
            names += ["amount", "cap", "height_start", "height_end", "offset_start", "offset_end"]
        for name in names:
            if get(name) is not None:
                out += [tags[name], ord(get(name)) if name == "symbol" else int(get(name))]
    if get("mint"):
        for part in get("mint").split(":"):
            out += [tags["mint"], int(part)]
    if get("pointer") is not None:
        out += [tags["pointer"], get("pointer")]
    edicts = sorted(get("edicts") or [], key=lambda e: (e["block"], e["tx"]))
    if edicts:
        out.append(0)
        block = tx = 0
        for e in edicts:
            more = e["block"] - block
            out += [more, e["tx"] if more else e["tx"] - tx, int(e["amount"]), e["output"]]
            block, tx = e["block"], e["tx"]
    payload = b"".join(map(codecs.write_varint, out))
    if len(payload) > MOST_PAYLOAD:
        return None
    push = bytes([len(payload)]) if len(payload) <= 75 else b"\x4c" + bytes([len(payload)])
    return b"\x6a\x5d" + push + payload


def edict_script(edicts: Column) -> Column:
    """The script of a runestone with only edicts (array of struct block, tx, amount as text, output); null if it is too long."""

    def run(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else encipher({"edicts": list(v)}) for v in values], dtype=object)

    return F.pandas_udf(run, "binary")(edicts)
