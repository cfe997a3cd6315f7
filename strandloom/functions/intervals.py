"""Columns over closed intervals of positions counted from 1. A null end gives null."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Interval:
    """Two columns, first and last."""

    first: Column
    last: Column

    @property
    def length(self) -> Column:
        return self.last - self.first + 1

    @property
    def is_reverse(self) -> Column:
        """The ends are given from right to left."""
        return self.first > self.last

    def oriented(self) -> Interval:
        return Interval(F.least(self.first, self.last), F.greatest(self.first, self.last))

    def overlaps(self, other: Interval) -> Column:
        return (self.first <= other.last) & (other.first <= self.last)

    def same(self, other: Interval) -> Column:
        return (self.first == other.first) & (self.last == other.last)

    def ordered(self, other: Interval) -> Column:
        return self.first <= other.first

    def precedes(self, other: Interval) -> Column:
        return self.first < other.first

    def shadows(self, other: Interval) -> Column:
        """Longer than the other and covering it."""
        return (self.length > other.length) & (self.first <= other.first) & (self.last >= other.last)

    def overlap(self, other: Interval) -> Interval:
        return Interval(F.greatest(self.first, other.first), F.least(self.last, other.last))

    def before_overlap(self, other: Interval) -> Interval:
        """What one of two overlapping intervals has before the overlap; null ends if they start together."""
        apart = self.first != other.first
        return Interval(F.when(apart, F.least(self.first, other.first)), F.when(apart, F.greatest(self.first, other.first) - 1))

    def after_overlap(self, other: Interval) -> Interval:
        """What one of two overlapping intervals has after the overlap; null ends if they end together."""
        apart = self.last != other.last
        return Interval(F.when(apart, F.least(self.last, other.last) + 1), F.when(apart, F.greatest(self.last, other.last)))

    def hull(self, other: Interval) -> Interval:
        """The range of two overlapping intervals; null ends if they don't overlap."""
        meets = self.overlaps(other)
        return Interval(F.when(meets, F.least(self.first, other.first)), F.when(meets, F.greatest(self.last, other.last)))

    def longer(self, other: Interval) -> Interval:
        """The longer one; this one if they are equally long."""
        mine = self.length >= other.length
        return Interval(F.when(mine, self.first).otherwise(other.first), F.when(mine, self.last).otherwise(other.last))


def subject_to_full(position: Column, first: Column, last: Column) -> Column:
    """A position of the aligned part as one of the whole subject; null outside."""
    full = position + first - 1
    return F.when((position >= 1) & (full <= last), full)


def full_to_subject(position: Column, first: Column, last: Column) -> Column:
    """A position of the whole subject as one of the aligned part; null outside."""
    return F.when((position >= first) & (position <= last), position - first + 1)


def codon(position: Column, query_first: Column, query_last: Column) -> Interval:
    """The three letters of the whole query behind an amino acid of the aligned query, on the strand it is read on."""
    left, right = F.least(query_first, query_last), F.greatest(query_first, query_last)
    back = query_first > query_last
    first = F.when(back, right - (position - 1) * 3).otherwise(left + (position - 1) * 3)
    return Interval(first, F.when(back, first - 2).otherwise(first + 2))
