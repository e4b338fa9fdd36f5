"""Column expressions for skill strings (SC-05, SC-06, SC-12, SC-14, SC-21, FLT-02).

Membership tests against the fixed word lists compile to ``InSet`` hash
lookups (Catalyst's OptimizeIn), so validity stays a codegen'd predicate.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lookups as L
from .text import WS_CLASS, col, py_strip

NON_WS_RUN = f"[^{WS_CLASS[1:]}+"

CASED = r"\p{Lu}\p{Ll}\p{Lt}"
WORDISH = r"\pL\pN_"


def py_split(c) -> Column:
    """Python ``str.split()`` (whitespace runs, no empty pieces).

    Matches, as ``split`` compiles its pattern anew for every row.
    """
    return F.regexp_extract_all(col(c), F.lit(NON_WS_RUN), 0)


def canon(c) -> Column:
    """SC-21: ``s.lower().strip()``."""
    return py_strip(F.lower(col(c)))


def cleanup(c) -> Column:
    """SC-05: lower, strip, then trim edge characters other than word, '+', '#'."""
    s = py_strip(F.lower(col(c)))
    return F.regexp_replace(s, f"^[^{WORDISH}+#]+|[^{WORDISH}+#]+$", "")


def squash(c) -> Column:
    """' '.join(x.split())."""
    return F.array_join(py_split(c), " ")


def probe_hyphen(c) -> Column:
    return F.replace(col(c), F.lit("-"), F.lit(" "))


def probe_dot_slash(c) -> Column:
    return squash(F.translate(col(c), "./", "  "))


def alias_variant(c) -> Column:
    """SC-12: '-', '.', '/' -> space, whitespace collapsed."""
    return squash(F.translate(col(c), "-./", "   "))


def title_case(c) -> Column:
    """Python ``str.title()``: a cased letter after a non-cased char is upper."""
    runs = F.regexp_extract_all(col(c), F.lit(f"[{CASED}]+|[^{CASED}]+"), 0)
    fixed = F.transform(
        runs,
        lambda r: F.when(r.rlike(f"^[{CASED}]"),
                         F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1 << 30))))
        .otherwise(r),
    )
    return F.array_join(fixed, "")


def _override_map() -> Column:
    kv = []
    for k, v in L.DISPLAY_OVERRIDES:
        kv += [F.lit(k), F.lit(v)]
    return F.create_map(*kv)


def display_name(c) -> Column:
    """SC-06: fixed override, else title case of the stripped string."""
    x = col(c)
    return F.when(x.isNull() | (x == ""), F.lit("")).otherwise(
        F.coalesce(F.try_element_at(_override_map(), canon(x)), title_case(py_strip(x))))


def curated_display(c) -> Column:
    """SC-14: title case when longer than 4 characters, else upper case."""
    x = col(c)
    return F.when(F.char_length(x) > 4, title_case(x)).otherwise(F.upper(x))


def is_valid_skill(c) -> Column:
    """FLT-02: skill validity rules, in order, as one boolean expression.

    The string and its words are bound as lambda variables: each is made once
    for all rules.
    """
    req = sorted(L.REQUIRED_MULTI)
    allowed = sorted(L.ALLOWED_SINGLE)
    block = sorted(L.BLOCKLIST)

    def parts(s):
        s_sp = probe_hyphen(s)
        toks = py_split(s)
        return F.struct(s.alias("s"), s_sp.alias("s_sp"), toks.alias("toks"),
                        F.when(s_sp == s, F.size(toks)).otherwise(F.size(py_split(s_sp))).alias("n_sp"))

    def rules(v):
        s, s_sp, n, n_sp = v["s"], v["s_sp"], F.size(v["toks"]), v["n_sp"]
        rule1 = ((n > 1) & s.isin(req)) | ((n_sp > 1) & s_sp.isin(req))
        rule2 = ((n == 1) & s.isin(allowed)) | ((n_sp == 1) & s_sp.isin(allowed))
        rule3 = (n == 1) & s.isin(block)
        return (
            F.when(s.isNull() | (s == ""), F.lit(False))
            .when(rule1, F.lit(True))
            .when(rule2, F.lit(True))
            .when(rule3, F.lit(False))
            .when(n > 1, ~F.forall(v["toks"], lambda t: t.isin(block)))
            .otherwise(F.lit(False))
        )

    return F.exists(F.transform(F.array(py_strip(F.lower(col(c)))), parts), rules)
