"""Protocol actions in JSON: what they ask for, and why they are refused."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerweave.functions import decimals, names

#: Fixed values of the rules.
SELF_MINT_HEIGHT = 837_090
MOST_N = 100_000_000


def field(body: Column, key: str) -> Column:
    """A top-level value as text; null if absent."""
    return F.get_json_object(body, f"$.{key}")


def text_field(body: Column, key: str) -> Column:
    """A value that must be a JSON string; null for numbers, which the rules refuse, and if absent."""
    return F.when(body.rlike(rf'"{key}"\s*:\s*"'), field(body, key))


def protocol(body: Column) -> Column:
    return F.lower(field(body, "p"))


def first_reason(*rules: tuple[str, Column]) -> Column:
    """The name of the first rule that is broken (true); null if none is. A rule that is null isn't broken."""
    return F.coalesce(*(F.when(broken, F.lit(name)) for name, broken in rules))


def token_action(body: Column) -> Column:
    """struct(op, tick, amt, reason) of a brc-20 action: op in deploy, mint, transfer; ticker of four or five bytes; amt a JSON string."""
    op, tick = field(body, "op"), field(body, "tick")
    amount = text_field(body, "amt")
    size = F.octet_length(tick)
    reason = first_reason(
        ("not brc-20", ~F.coalesce(field(body, "p") == "brc-20", F.lit(False))), ("unknown op", ~F.coalesce(op.isin("deploy", "mint", "transfer"), F.lit(False))),
        ("ticker length", ~F.coalesce(size.isin(4, 5), F.lit(False))), ("amount", op.isin("mint", "transfer") & decimals.token_amount(amount).isNull()),
    )
    return F.struct(op.alias("op"), F.lower(tick).alias("tick"), amount.alias("amt"), reason.alias("reason"))


def token_deploy(body: Column, height: Column) -> Column:
    """struct(tick, max, lim, dec, self_mint, reason) of a brc-20 deploy.

    A ticker of five bytes needs self_mint "true" and the height from which it is allowed. dec is 18 unless given, at
    most 18. max must be positive; 0 means the largest number, for self-mints only. lim is max unless given, and not 0.
    """
    tick = field(body, "tick")
    dec = F.when(field(body, "dec").isNull(), F.lit(18)).otherwise(F.when(text_field(body, "dec").rlike("^[0-9]{1,2}$"), text_field(body, "dec").try_cast("int")))
    self_mint = F.coalesce(field(body, "self_mint") == "true", F.lit(False))
    given = decimals.token_amount(text_field(body, "max"))
    most = F.when((given == 0) & self_mint & (F.octet_length(tick) == 5), F.lit(str(decimals.UINT64_MAX)).cast("decimal(38,18)")).otherwise(given)
    limit = F.when(field(body, "lim").isNull(), most).otherwise(decimals.token_amount(text_field(body, "lim")))
    limit = F.when((limit == 0) & self_mint, most).otherwise(limit)
    five = F.octet_length(tick) == 5
    reason = first_reason(
        ("self-mint height", five & (height < SELF_MINT_HEIGHT)), ("self-mint flag", five & ~self_mint), ("decimals", dec.isNull() | (dec > 18)),
        ("max", most.isNull() | (most <= 0)), ("lim", limit.isNull() | (limit <= 0)),
    )
    return F.struct(F.lower(tick).alias("tick"), most.alias("max"), limit.alias("lim"), dec.alias("dec"), self_mint.alias("self_mint"), reason.alias("reason"))


def ordx_deploy(body: Column, height: Column, window_ahead: int = 1000) -> Column:
    """struct(tick, lim, n, max, selfmint, start, end, reason) of an ordx deploy.

    lim is at least 0 (default 10000), n from 1 to 1e8 (default 1), both lim and max multiples of n. selfmint is at most 100
    percent and needs max. A block window is ordered and, below 100 percent, begins so many blocks ahead.
    """
    number = lambda key, default: F.when(field(body, key).isNull(), F.lit(default)).otherwise(field(body, key).try_cast("bigint"))
    tick, lim, n, most = field(body, "tick"), number("lim", 10_000), number("n", 1), number("max", -1)
    percent = F.when(field(body, "selfmint").isNull(), F.lit(0)).otherwise(names.percentage(field(body, "selfmint")))
    window = F.split(field(body, "block"), "-")
    start, end = F.try_element_at(window, F.lit(1)).try_cast("int"), F.try_element_at(window, F.lit(2)).try_cast("int")
    asked = field(body, "block").isNotNull()
    reason = first_reason(
        ("name", ~names.is_ticker_name(tick)), ("lim", lim.isNull() | (lim < 0)), ("n", n.isNull() | ~n.between(1, MOST_N)), ("lim by n", F.try_mod(lim, n) != 0), ("max by n", (most > 0) & (F.try_mod(most, n) != 0)),
        ("selfmint", percent.isNull()), ("selfmint without max", (percent > 0) & (most <= 0)), ("block window", asked & (start.isNull() | end.isNull() | (start > end))),
        ("block start", asked & (percent < 100) & (start < height + window_ahead)),
    )
    return F.struct(F.lower(tick).alias("tick"), lim.alias("lim"), n.alias("n"), most.alias("max"), percent.alias("selfmint"), start.alias("start"), end.alias("end"), reason.alias("reason"))


def ordx_mint(amount: Column, height: Column, limit: Column, n: Column, left: Column, start: Column, end: Column) -> Column:
    """Why a mint of a deployed ticker is refused; null if it isn't."""
    return first_reason(("window", (start.isNotNull() & (height < start)) | (end.isNotNull() & (height > end))), ("amount", amount.isNull() | (amount <= 0)), ("limit", amount > limit), ("by n", F.try_mod(amount, n) != 0), ("left", amount > left))


def pairs_of(body: Column) -> Column:
    """An update's key-value pairs: those of a `kvs` list of `k=v`, else all of the top level but p, op and name."""
    listed = F.from_json(field(body, "kvs"), "array<string>")
    split = F.transform(F.filter(listed, lambda e: e.contains("=")), lambda e: F.struct(F.split(e, "=", 2)[0].alias("k"), F.split(e, "=", 2)[1].alias("v")))
    flat = F.map_filter(F.from_json(body, "map<string,string>"), lambda k, _: ~k.isin("p", "op", "name", "kvs"))
    return F.when(listed.isNotNull(), F.map_from_entries(split)).otherwise(flat)
