"""Protocol rules whose outcome depends on what earlier rows of the same key did.

Each is a fold over rows in order. ordered_fold deals keys over tasks, sorts inside them and streams batches through the
fold, so a task holds a batch and the state of one key, never a key's rows.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], Callable], schema: str) -> DataFrame:
    """Rows that a fold returns for each row of df, by key and in order.

    start() makes a key's fold: a function of a row (a named tuple) that returns a list of output tuples of schema.
    Nulls in keys are keys of their own. order must be total within a key.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [part.strip().split()[0].strip("`") for part in schema.split(",")]
        last, fold = object(), None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                key = tuple(None if pd.isna(v := getattr(row, k)) else v for k in keys)
                if key != last:
                    last, fold = key, start()
                out += fold(row)
            yield pd.DataFrame(out, columns=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


class SkippingCap:
    """Mints up to a cap (rows: ticker, seq, amount); one that would pass it is refused whole, and a later smaller one may still fit."""

    def __init__(self, cap: int):
        self.left = cap

    def __call__(self, row) -> list[tuple]:
        fits = row.amount <= self.left
        self.left -= row.amount if fits else 0
        return [(row.ticker, row.seq, row.amount, bool(fits), self.left)]

    def dump(self) -> str:
        return json.dumps(int(self.left))

    def load(self, text: str) -> None:
        self.left = json.loads(text)


SKIPPED = "ticker long, seq long, amount long, accepted boolean, left_after long"


class TokenAccount:
    """Deploy, mint, inscribe a transfer, move it or cancel it, for one ticker.

    Rows: ticker, seq, owner, receiver, action, amount. The first deploy counts. A mint needs a deploy and at most
    per_mint; the last one is cut to what is left of most. Inscribing needs so much available, which becomes
    transferable; moving credits the receiver with the owner's oldest inscribed transfer, cancelling gives it back.
    """

    def __init__(self, most: int, per_mint: int):
        self.deployed, self.left, self.per_mint = False, most, per_mint
        self.available: dict[int, int] = {}
        self.inscribed: dict[int, deque[int]] = {}
        self.waiting: dict[int, int] = {}  # sums of inscribed

    def __call__(self, row) -> list[tuple]:
        amount, accepted = 0, False
        mine = self.available.get(row.owner, 0)
        if row.action == "deploy":
            accepted, self.deployed = not self.deployed, True
        elif row.action == "mint" and self.deployed and 0 < row.amount <= self.per_mint and self.left:
            amount, accepted = min(row.amount, self.left), True
            self.left -= amount
            self.available[row.owner] = mine + amount
        elif row.action == "inscribe" and 0 < row.amount <= mine:
            amount, accepted = row.amount, True
            self.available[row.owner] = mine - amount
            self.inscribed.setdefault(row.owner, deque()).append(amount)
            self.waiting[row.owner] = self.waiting.get(row.owner, 0) + amount
        elif row.action in ("move", "cancel") and self.inscribed.get(row.owner):
            amount, accepted = self.inscribed[row.owner].popleft(), True
            self.waiting[row.owner] -= amount
            to = row.receiver if row.action == "move" else row.owner
            self.available[to] = self.available.get(to, 0) + amount
        return [(row.ticker, row.seq, row.owner, row.action, accepted, amount, self.available.get(row.owner, 0), self.waiting.get(row.owner, 0))]

    def dump(self) -> str:
        held = [[int(k), int(v)] for k, v in self.available.items()]
        waiting = [[int(k), list(map(int, v))] for k, v in self.inscribed.items() if v]
        return json.dumps([self.deployed, int(self.left), held, waiting])

    def load(self, text: str) -> None:
        self.deployed, self.left, held, waiting = json.loads(text)
        self.available = dict(map(tuple, held))
        self.inscribed = {k: deque(v) for k, v in waiting}
        self.waiting = {k: sum(v) for k, v in waiting}


ACCOUNT = "ticker long, seq long, owner long, action string, accepted boolean, amount long, available long, transferable long"


def apply_edicts(unallocated: dict, edicts: list[tuple], outputs: int, eligible: list[int], pointer: int | None = None, cenotaph: bool = False) -> tuple[dict, dict]:
    """(allocated, burned) of one transaction: allocated maps (output, rune) to amounts, burned maps runes.

    edicts are (rune, amount, output) in order. An edict for output == outputs goes to all eligible outputs: amount 0
    splits what is left evenly, the first ones getting one more, else each gets amount while there is any. For one output,
    amount 0 is all and more than what is left is what is left. The rest goes to the pointer, else to the first eligible
    output; without one it burns. A cenotaph burns everything.
    """
    left = dict(unallocated)
    if cenotaph:
        return {}, {r: n for r, n in left.items() if n}
    allocated: dict = {}

    def give(rune, output, amount):
        amount = min(amount, left.get(rune, 0))
        if amount:
            left[rune] -= amount
            allocated[output, rune] = allocated.get((output, rune), 0) + amount

    for rune, amount, output in edicts:
        have = left.get(rune, 0)
        if not have or output > outputs:
            continue
        if output < outputs:
            give(rune, output, amount or have)
        elif eligible and amount == 0:
            each, more = divmod(have, len(eligible))
            for k, o in enumerate(eligible):
                give(rune, o, each + (k < more))
        else:
            for o in eligible:
                give(rune, o, amount)
    rest = pointer if pointer is not None else (eligible[0] if eligible else None)
    burned = {}
    for rune, n in left.items():
        if n and rest is not None and rest in eligible:
            allocated[rest, rune] = allocated.get((rest, rune), 0) + n
        elif n:
            burned[rune] = n
    return allocated, burned


def colour(assets: list[tuple], outputs: list[int], partial: bool) -> tuple[dict, dict]:
    """(coloured, burned): coloured maps (output, asset) to amounts, for assets (asset, amount) in input order.

    Outputs are coloured one after another, whole ones only unless partial. If any asset has a rest, all begin again at
    output 0, each for itself, and what then doesn't fit burns.
    """

    def run(each_alone: bool) -> tuple[dict, dict]:
        got, rest, at = {}, {}, 0
        for asset, amount in assets:
            at = 0 if each_alone else at
            while amount and at < len(outputs) and (outputs[at] <= amount or partial):
                part = min(outputs[at], amount)
                got[at, asset] = got.get((at, asset), 0) + part
                amount, at = amount - part, at + 1
            if amount:
                rest[asset] = rest.get(asset, 0) + amount
        return got, rest

    got, rest = run(False)
    return run(True) if rest else (got, rest)


def split_colour(assets: list[tuple], outputs: list[int], skips: dict) -> tuple[dict, dict]:
    """As colour with partial outputs, each asset for itself after skipping so much value of the outputs."""
    got, rest = {}, {}
    for asset, amount in assets:
        skip, at = skips.get(asset, 0), 0
        while at < len(outputs) and skip >= outputs[at] > 0:
            skip, at = skip - outputs[at], at + 1
        while amount and at < len(outputs):
            part = min(outputs[at], amount)
            if part:
                got[at, asset] = got.get((at, asset), 0) + part
            amount, at = amount - part, at + 1
        if amount:
            rest[asset] = amount
    return got, rest


def by_transaction(rows: DataFrame, tx: str, order: list[str], rule: Callable[[list], list[tuple]], schema: str) -> DataFrame:
    """What rule makes of each transaction's rows. A transaction is bounded by a block, so its rows fit a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [part.strip().split()[0] for part in schema.split(",")]
        held, last = [], None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if held and getattr(row, tx) != last:
                    out += rule(held)
                    held = []
                held.append(row)
                last = getattr(row, tx)
            yield pd.DataFrame(out, columns=names)
        if held:
            yield pd.DataFrame(rule(held), columns=names)

    return rows.repartition(tx).sortWithinPartitions(tx, *order).mapInPandas(run, schema)


def freeze_account(units_burn: bool = True):
    """Freeze, unfreeze, receive and spend, for one ticker and address (rows: ticker, owner, seq, action, amount).

    Freezing takes a snapshot of the units held; a spend burns frozen units first while the address is frozen.
    """

    def start():
        held, frozen, is_frozen = 0, 0, False

        def fold(row):
            nonlocal held, frozen, is_frozen
            burned = 0
            if row.action == "freeze" and not is_frozen:
                is_frozen, frozen = True, held
            elif row.action == "unfreeze":
                is_frozen, frozen = False, 0
            elif row.action == "receive":
                held += row.amount
            elif row.action == "spend":
                spent = min(row.amount, held)
                burned = min(spent, frozen) if is_frozen and units_burn else 0
                held, frozen = held - spent, frozen - burned
            return [(row.ticker, row.owner, row.seq, row.action, held, frozen, burned, is_frozen)]

        return fold

    return start


FROZEN = "ticker long, owner long, seq long, action string, held long, frozen long, burned long, is_frozen boolean"


def mintable(height, start, end, mints, cap):
    """Whether a rune may be minted: terms, an open window and mints below the cap (columns)."""
    return (start.isNull() | (height >= start)) & (end.isNull() | (height < end)) & (F.coalesce(mints, F.lit(0)) < cap)


def rune_supply(premine, mints, amount):
    return F.coalesce(premine, F.lit(0)) + F.coalesce(mints, F.lit(0)) * F.coalesce(amount, F.lit(0))
