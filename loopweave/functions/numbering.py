"""Positions of residues by aligning sequences to profiles.

A profile has a weight for each letter at each of its positions. A sequence is aligned to it from end to end with affine gaps: a position
may be skipped, and residues between two positions are insertions, which take the number of the position before them. Of several
profiles (chains, germlines, families) the one with the highest score numbers a sequence.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import ALPHABET

#: Weights are whole numbers, tenths of a bit, so that sums are exact and ties are ties; costs of a gap's first place and of further ones.
SCALE, OPEN, EXTEND = 10, 40, 5
#: Positions and profiles at most: profiles travel to every task.
MOST_POSITIONS, MOST_PROFILES = 1_000, 1_000
_NONE = -(10**9)


def profiles_of(numbered: DataFrame, profile: str = "profile", position: str = "imgt_pos", letter: str = "one_letter", pseudo: float = 1.0) -> DataFrame:
    """(profile, position, letter, weight) from residues whose numbers are trusted: ``SCALE`` times the binary logarithm of a letter's share at a
    position over an even share, with ``pseudo`` added to each letter's count. Residues without a number or with a letter that is none of the twenty are left out; a
    position that never occurs is not in the profile."""
    known = numbered.where(F.col(position).isNotNull() & F.col(letter).isin(*ALPHABET)).groupBy(F.col(profile).alias("profile"), F.col(position).alias("position"), F.col(letter).alias("letter")).agg(F.count("*").alias("n"))
    totals = known.groupBy("profile", "position").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("letter", "n"))).alias("seen"))  # twenty letters at most
    counted = totals.select("profile", "position", "all", "seen", F.explode(F.array(*map(F.lit, ALPHABET))).alias("letter"))
    share = (F.coalesce(F.try_element_at("seen", "letter"), F.lit(0)) + pseudo) / (F.col("all") + pseudo * len(ALPHABET))
    return counted.select("profile", "position", "letter", F.round(SCALE * F.log2(share * len(ALPHABET))).cast("int").alias("weight"))


@dataclass(frozen=True)
class Profile:
    name: str
    positions: np.ndarray  # (P,) numbers, ascending
    weights: np.ndarray  # (P, 21) by letter; the last is any other letter's, 0


def align(profile: Profile, sequences: list[str], opening: int = OPEN, extending: int = EXTEND) -> tuple[np.ndarray, list[list[int | None]]]:
    """Scores, and the position of each residue of each sequence; None before the first position that is matched or skipped.

    Positions are gone through one by one, for all sequences and all their places at once; along a sequence insertions are a running maximum. Of equal
    scores a match goes before a skipped position, and that before an insertion."""
    size = np.array([len(s) for s in sequences], int)
    places, positions = int(size.max(initial=0)), len(profile.positions)
    code = np.full((len(sequences), places), len(ALPHABET))
    index = {a: k for k, a in enumerate(ALPHABET)}
    for b, s in enumerate(sequences):
        code[b, : len(s)] = [index.get(c, len(ALPHABET)) for c in s]
    shape = (positions + 1, len(sequences), places + 1)
    match, skip, insert = (np.full(shape, _NONE, np.int64) for _ in range(3))
    steps = extending * np.arange(places + 1)

    def inserted(p: int) -> None:
        start = np.maximum(match[p], skip[p]) - opening + steps
        insert[p, :, 1:] = np.maximum.accumulate(start, 1)[:, :-1] - steps[:-1]

    match[0, :, 0] = 0
    inserted(0)
    for p in range(1, positions + 1):
        before = np.maximum(np.maximum(match[p - 1], skip[p - 1]), insert[p - 1])
        match[p, :, 1:] = before[:, :-1] + profile.weights[p - 1][code]
        skip[p] = np.maximum(np.maximum(match[p - 1], insert[p - 1]) - opening, skip[p - 1] - extending)
        inserted(p)

    rows = np.arange(len(sequences))
    p, at = np.full(len(sequences), positions), size.copy()
    last = np.stack([match[p, rows, at], skip[p, rows, at], insert[p, rows, at]])
    state, score = last.argmax(0), last.max(0)  # the first of equal ones
    out = np.full((len(sequences), places), -1)
    while ((p > 0) | (at > 0)).any():
        going = (p > 0) | (at > 0)
        emits = going & (state != 1)
        out[rows[emits], at[emits] - 1] = p[emits] - 1
        p2, at2 = p - (going & (state != 2)), at - (going & (state != 1))
        came = np.stack([match[p2, rows, at2], skip[p2, rows, at2], insert[p2, rows, at2]])
        # what a step from each state costs: nothing to a match, opening or extending a gap to the others
        cost = np.where(state == 0, 0, opening)[None, :].repeat(3, 0)
        cost[1, state == 1], cost[2, state == 2] = extending, extending
        state, p, at = np.where(going, (came - cost).argmax(0), state), p2, at2
    return score, [[int(profile.positions[k]) if k >= 0 else None for k in out[b, : size[b]]] for b in range(len(sequences))]


class Aligner:
    """Numbers sequences by the best of some profiles; a function for ``annotate``. Empty sequences have no positions."""

    def __init__(self, profiles: list[Profile], opening: int = OPEN, extending: int = EXTEND, batch: int = 256):
        if not 1 <= len(profiles) <= MOST_PROFILES or any(not 1 <= len(p.positions) <= MOST_POSITIONS for p in profiles):
            raise ValueError(f"between 1 and {MOST_PROFILES} profiles of 1 to {MOST_POSITIONS} positions are needed")
        if not 0 <= extending <= opening:
            raise ValueError(f"a gap of {opening} and {extending} is not possible: further places cost no more than the first")
        self.profiles, self.opening, self.extending, self.batch = sorted(profiles, key=lambda p: p.name), opening, extending, batch

    @classmethod
    def of(cls, profiles: DataFrame, **options) -> Aligner:
        """From (profile, position, letter, weight): a parameter table, read on the driver; its size is checked first. A weight that is not there is 0."""
        most = MOST_PROFILES * MOST_POSITIONS
        rows = profiles.select(F.col("profile").cast("string"), "position", "letter", "weight").limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"profiles have more than {most} weights")
        table: dict[str, dict[int, np.ndarray]] = {}
        for r in rows:
            weights = table.setdefault(r.profile, {}).setdefault(r.position, np.zeros(len(ALPHABET) + 1, np.int64))
            if r.letter in ALPHABET:
                weights[ALPHABET.index(r.letter)] = r.weight
        return cls([Profile(n, np.array(sorted(t)), np.stack([t[p] for p in sorted(t)])) for n, t in table.items()], **options)

    def many(self, sequences: list[str]) -> list[list[int | None]]:
        """Positions of each sequence; sequences of about one length are aligned together."""
        out: list[list[int | None]] = [[] for _ in sequences]
        order = sorted(range(len(sequences)), key=lambda k: len(sequences[k] or ""))
        for lo in range(0, len(order), self.batch):
            some = order[lo : lo + self.batch]
            best = np.full(len(some), _NONE * 10, np.int64)
            for profile in self.profiles:
                score, found = align(profile, [sequences[k] or "" for k in some], self.opening, self.extending)
                for b in np.flatnonzero(score > best):
                    out[some[b]], best[b] = found[b], score[b]
        return out

    def __call__(self, sequence: str) -> list[int | None]:
        return self.many([sequence])[0]
