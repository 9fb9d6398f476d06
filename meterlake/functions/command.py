"""The command that a shell call runs, as column expressions over its parsed arguments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from meterlake.functions.scalar import bounded

# Tools that wrap a shell, shells, words before a command, and the tokens looked at.
WRAPPERS = ("exec_command", "shell", "local_shell", "unified_exec")
SHELLS = ("bash", "sh", "zsh", "dash")
PREFIXES = ("env", "sudo", "time", "nice")
TOKENS = 64
SPACE = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value evaluated once, whatever the number of its uses."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _words(text: Column, most: int) -> Column:
    """The first words of a text; what follows them is not split."""
    return F.slice(F.array_remove(F.split(F.regexp_replace(text, "^" + SPACE, ""), SPACE, most + 1), ""), 1, most)


def unquoted(token: Column) -> Column:
    """Without one pair of equal quotes around it."""
    around = lambda t, q: t.startswith(q) & t.endswith(q) & (F.length(t) > 1)
    return _let(token, lambda t: F.when(around(t, '"') | around(t, "'"), F.substr(t, F.lit(2), F.length(t) - 2)).otherwise(t))


def basename(token: Column) -> Column:
    """What follows the last slash; null for nothing, subshells and assignments."""
    named = lambda bare: F.when(~bare.startswith("(") & ~bare.contains("="), F.nullif(F.substring_index(bare, "/", -1), F.lit("")))
    return bounded(_let(unquoted(token), named))


def _effective(tokens: Column) -> Column:
    flags = F.transform(F.slice(tokens, 2, TOKENS), lambda t: t.startswith("-") & ~t.startswith("--") & t.contains("c"))
    shell = F.coalesce(basename(F.get(tokens, F.lit(0))).isin(*SHELLS), F.lit(False))
    plain = lambda t: ~t.rlike("^[A-Za-z_][A-Za-z0-9_]*=") & ~F.coalesce(basename(t).isin(*PREFIXES), F.lit(False))
    real = F.get(F.filter(F.transform(tokens, unquoted), plain), F.lit(0))
    # the script is the token after the flag
    script = lambda n: F.when(shell & (n > 0), F.get(_words(F.get(tokens, n.cast("int") + 1), 1), F.lit(0))).otherwise(real)
    return _let(F.array_position(flags, F.lit(True)), script)


def command_name(arguments: Column) -> Column:
    """Base name of the command in ``command`` or ``cmd``, a text or a list of texts.

    A shell with a ``-c`` flag runs its script's first word; otherwise the first token counts
    that is neither an assignment nor ``env``, ``sudo``, ``time`` or ``nice``.
    """

    def tokens(value: Column) -> Column:
        texts = F.filter(F.try_variant_get(value, "$", "array<variant>"), lambda x: F.schema_of_variant(x) == "STRING")
        listed = F.transform(F.slice(texts, 1, TOKENS), lambda x: F.try_variant_get(x, "$", "string"))
        kind = F.schema_of_variant(value)
        return F.when(kind == "STRING", _words(F.try_variant_get(value, "$", "string"), TOKENS)).when(kind.startswith("ARRAY"), listed)

    value = F.coalesce(F.try_variant_get(arguments, "$.command", "variant"), F.try_variant_get(arguments, "$.cmd", "variant"))
    return basename(unquoted(_let(_let(value, tokens), _effective)))
