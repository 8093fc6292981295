"""Classification and anonymisation of endpoints, as pure expressions.

Classes: 0 IPv4, 1 IPv6, -1 anything else, which stays as it is.  No number is validated.  Masking keeps
separators and lengths; what it keeps of short ``::`` forms is documented in the README.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clip_endpoint

#: An address with, perhaps, a zone of at least one letter or digit.
_ALLOWED = r"^[0-9A-Fa-f.:]*(?:%[_-]*[0-9A-Za-z][0-9A-Za-z_-]*)?\z"


def _count(c: Column, what: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(what), F.lit("")))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, for which value is evaluated once a row: written out at every place it would multiply with each step."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def strip_brackets(s: Column) -> Column:
    """``[x]...`` -> ``x``."""
    return F.when(s.startswith("[") & s.contains("]"), F.substring(F.substring_index(s, "]", 1), F.lit(2), F.length(s))).otherwise(s)


def classify_ip(s: Column, strict: bool = False) -> Column:
    """0, 1 or -1; with ``strict`` an address with a prefix length counts as the address."""

    def kind(a: Column) -> Column:
        colons, dots = _count(a, ":"), _count(a, ".")
        last = lambda ch: F.length(a) - F.length(F.substring_index(a, ch, -1))
        return (
            F.when(~(F.octet_length(a).between(1, 80) & a.rlike(_ALLOWED)), -1)
            .when(colons == 0, F.when(dots == 3, 0).otherwise(-1))
            .when((dots == 3) & (colons == 1) & (last(":") > last(".")), 0)
            .when(((colons == 7) & (dots == 0)) | a.contains("::") | (dots == 0) | (dots == 3), 1)
            .otherwise(-1)
        )

    plain = lambda a: F.regexp_replace(a, r"/\d{1,3}$", "") if strict else a
    return F.coalesce(_let(s, lambda whole: _let(plain(strip_brackets(whole)), kind)), F.lit(-1))


def _masked(s: Column, stops: str, mask: Callable[[Column], Column]) -> Column:
    """What stands between an opening bracket and the first stop, masked."""
    head = F.when(s.startswith("["), F.lit("[")).otherwise(F.lit(""))

    def parts(body: Column) -> Column:
        address = body
        for stop in stops:
            address = F.substring_index(address, stop, 1)
        return _let(address, lambda a: F.concat(head, mask(a), F.substring(body, F.length(a) + 1, F.length(body))))

    return _let(F.when(s.startswith("["), F.substring(s, F.lit(2), F.length(s))).otherwise(s), parts)


def _hide(address: Column, between: str, keep: Column, what: str) -> Column:
    """The first ``keep`` tokens as they are, an x for every ``what`` in those behind them; separators stay."""
    shown = F.call_function("substring_index", address, F.lit(between), keep)
    return _let(shown, lambda a: F.concat(a, F.regexp_replace(F.substring(address, F.length(a) + 1, F.length(address)), what, "x")))


def _mask_v4(s: Column, level: int, collapse: bool) -> Column:
    return _masked(s, ":/%]", lambda address: _hide(address, ".", F.lit(4 - level), "[^.]+" if collapse else "[^.]"))


def _mask_v6(s: Column, level: int) -> Column:
    u = min(2 * level, 8)

    def mask(address: Column) -> Column:
        # the place of the empty token, where there is a ``::``
        gap = F.when(address.startswith("::"), 1).when(address.startswith(":"), 0).otherwise(_count(F.substring_index(address, "::", 1), ":") + 1)

        def keep(n: Column) -> Column:
            tail, zeros = n - 1 - gap, 9 - n
            return F.when(~address.contains("::") | (n == 9), n - F.least(F.lit(u), n)).when(u <= tail, n - u).when(u <= tail + zeros, gap).otherwise(gap - (u - tail - zeros))

        return _hide(address, ":", F.greatest(_let(_count(address, ":") + 1, keep), F.lit(0)), r"[^.:\[\]]")

    def broken(address: Column) -> Column:
        pairs, n = _count(address, "::") / 2, _count(address, ":") + 1
        return address.contains(":::") | (pairs > 1) | (n > 17) | ((pairs == 1) & (n > 9))

    return _masked(s, "]/%", lambda address: F.when(broken(address), address).otherwise(mask(address)))


def anon_ip(endpoint: Column, level: int, strict: bool = False, collapse: bool = False) -> Column:
    """``endpoint`` masked at level 0 (not at all) to 4 (whole), at most 79 bytes."""
    if level == 0:
        return clip_endpoint(endpoint)

    def masked(s: Column) -> Column:
        return _let(classify_ip(s, strict), lambda kind: F.when(kind == 0, _mask_v4(s, level, collapse)).when(kind == 1, _mask_v6(s, level)).otherwise(s))

    return _let(_let(endpoint, masked), clip_endpoint)
