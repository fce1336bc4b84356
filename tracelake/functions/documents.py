"""JSON text columns: canonical form, counts, nested redaction and truncation."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelake.functions.text import (
    MASK_RULES,
    MAX_DEPTH,
    MAX_ITEMS,
    MAX_TEXT,
    REDACTED,
    mask_rules,
    sensitive_keys,
)


def canonical_json(text: str) -> str:
    """SQL for key-sorted JSON text, '' for null; text that is no JSON stays as it is."""
    return f"coalesce(to_json(try_parse_json({text})), {text}, '')"


def json_text(text: str, key: str) -> str:
    """SQL for a member of a JSON object as text, null when absent or empty."""
    return f"nullif(try_variant_get(try_parse_json({text}), '$.{key}', 'string'), '')"


def json_counts(col: Column) -> Column:
    """JSON object of counts as a map; null when the text is malformed."""
    return F.try_variant_get(F.try_parse_json(col), "$", "map<string,bigint>")


def _rewriter(change: Callable[[object], object], plain: Callable[[str], str]) -> Callable[[str | None], str | None]:
    """Changes a JSON text; what the parser refuses, also for its depth, is changed as ``plain`` text."""

    def written(document: object) -> str:
        return json.dumps(document, sort_keys=True, ensure_ascii=False, separators=(",", ":"))

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            return written(change(json.loads(text)))
        except (ValueError, RecursionError):
            return written(plain(text))

    return one


def _rewrite(change: Callable[[object], object], plain: Callable[[str], str]) -> Callable[[pd.Series], pd.Series]:
    one = _rewriter(change, plain)

    def batch(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return batch


# What JSON text is made of: a string, a string that never ends, a bracket, comma or colon, white space, anything else.
_TOKEN = re.compile(r'("(?:[^"\\]|\\.)*")|("(?:[^"\\]|\\.)*\\?\Z)|([{}\[\],:])|([ \t\r\n]+)|([^"{}\[\],: \t\r\n]+)', re.S)
_BARE = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null|NaN|-?Infinity")
_COLON = re.compile(r"[ \t\r\n]*:")
# In text known to be JSON: a string, with the colon after it if it is a key, or white space.
_SAID = re.compile(r'"((?:[^"\\]|\\.)*)"([ \t\r\n]*:)?|[ \t\r\n]+')
# Tells whether text is JSON; what numbers are worth does not matter.
_VALUE = json.JSONDecoder(parse_int=str, parse_float=str, parse_constant=str).scan_once
_BLANK = re.compile(r"[ \t\r\n]*")
_BLANKS = re.compile(r"[ \t\r\n]+")
_BRACKET = re.compile(r"[{}\[\]]")
_SCALAR_END = re.compile(r"[,}\]]|\Z")

# What a text must contain for a standard rule to match at all.
_HINTS = {"[EMAIL_REDACTED]": "@", "[CARD_REDACTED]": r"\d{4}", "[SSN_REDACTED]": r"\d{3}-", "[KEY_REDACTED]": "(?i)sk-|bearer", "[PHONE_REDACTED]": r"\d{4}"}


def _end_of_value(text: str, at: int = 0) -> int:
    """Where the JSON value ends that begins at a place or after white space."""
    return _VALUE(text, _BLANK.match(text, at).end())[1]


class _Grammar:
    """Follows the tokens of a text and tells whether they are one JSON value; ``open`` is its own stack of brackets."""

    def __init__(self) -> None:
        self.open: list[str] = []
        self.sound, self.due = True, "value"

    def take(self, token: str) -> None:
        due, value = self.due, False
        if token in "{[":
            self.sound &= due in ("value", "value or end")
            self.open.append(token)
            self.due = "key or end" if token == "{" else "value or end"
            return
        if token in "}]":
            fits = bool(self.open) and self.open[-1] == {"}": "{", "]": "["}[token]
            self.sound &= fits and due in ("comma or end", "key or end" if token == "}" else "value or end")
            if self.open:
                self.open.pop()
            value = True
        elif token == ",":
            self.sound &= due == "comma or end" and bool(self.open)
            self.due = "key" if self.open and self.open[-1] == "{" else "value"
        elif token == ":":
            self.sound &= due == "colon"
            self.due = "value"
        elif due in ("key", "key or end"):
            self.sound &= token == '"'
            self.due = "colon"
        else:
            self.sound &= due in ("value", "value or end")
            value = True
        if value:
            self.due = "comma or end" if self.open else "nothing"


def mask_document(
    col: Column,
    extra_rules: Iterable[tuple[str, str]] = (),
    extra_keys: Iterable[str] = (),
) -> Column:
    """Redact a JSON document: whole values under sensitive keys, matches in every other string.

    The text is scanned token by token and copied; only strings and values under sensitive keys change, so numbers stay as
    written, members in their order, and depth does not matter. White space between tokens goes. Text that is no JSON is
    scanned alike, whatever follows a sensitive key is hidden up to where that value ends or the text does, the rest is masked
    as text, and all of it becomes one JSON string. This is an Arrow-batched Python step; patterns must be valid in both Java
    and Python regex.
    """
    one = _masking(extra_rules, extra_keys)
    return F.pandas_udf(lambda texts: texts.map(one), "string")(col)


def mask_document_lists(col: Column, extra_rules: Iterable[tuple[str, str]] = (), extra_keys: Iterable[str] = ()) -> Column:
    """``mask_document`` for each member of an array of JSON documents."""
    one = _masking(extra_rules, extra_keys)
    return F.pandas_udf(lambda lists: lists.map(lambda texts: None if texts is None else [one(t) for t in texts]), "array<string>")(col)


def _masking(extra_rules: Iterable[tuple[str, str]], extra_keys: Iterable[str]) -> Callable[[str | None], str | None]:
    rules = [
        (re.compile(_HINTS[rule[1]] if rule in MASK_RULES else ""), re.compile(rule[0]), rule[1]) for rule in mask_rules(extra_rules)
    ]
    keys = frozenset(sensitive_keys(extra_keys))

    def hidden(key: str) -> bool:
        name = key.lower().strip()
        return name in keys or not keys.isdisjoint(re.split(r"[_\-.]+", name))

    # standard rules together: text without any of this stays as it is
    worth = re.compile("|".join(f"(?i:{hint[4:]})" if hint.startswith("(?i)") else hint for hint in _HINTS.values()) if len(rules) == len(MASK_RULES) else "")

    def masked(text: str) -> str:
        if not worth.search(text):
            return text
        for hint, pattern, placeholder in rules:
            if hint.search(text):
                text = pattern.sub(placeholder, text)
        return text

    def quoted(text: str) -> str:
        return json.dumps(text, ensure_ascii=False)

    def said(token: str, grammar: _Grammar) -> str:
        try:
            return json.loads(token)
        except ValueError:
            grammar.sound = False
            return token.strip('"')

    def sound(text: str) -> bool | None:
        """Whether the text is JSON; null if it is nested too deep to tell."""
        try:
            return _BLANK.fullmatch(text, _end_of_value(text)) is not None
        except (ValueError, StopIteration):
            return False
        except RecursionError:
            return None

    def of_json(text: str) -> str:
        """Text known to be JSON: only strings are looked at, and what stays as it is is copied in one piece."""
        parts, done, after = [], 0, 0
        for found in _SAID.finditer(text):
            kind, at = found.lastindex, found.start()
            if at < after:  # in a value that is left out
                continue
            if kind is None:
                parts.append(text[done:at])
                done = found.end()
                continue
            token = found[1]
            if kind == 2:
                if secret_key(plain(token)):
                    after = _end_of_value(text, found.end())
                    parts += [text[done : found.end(1) + 1], f':"{REDACTED}"']
                    done = after
                elif found[2] != ":":
                    parts += [text[done : found.end(1) + 1], ":"]
                    done = found.end()
                continue
            clear = plain(token)
            clean = masked(clear)
            if clean != clear:
                parts += [text[done:at], quoted(clean)]
                done = found.end()
        parts.append(text[done:])
        return "".join(parts)

    def secret_key(name: str) -> bool:
        secret = seen.get(name)
        if secret is None:
            if len(seen) > 10_000:
                seen.clear()
            secret = seen[name] = hidden(name)
        return secret

    def of_plain_json(text: str) -> str:
        """``of_json`` for text without escapes, cut at its quotes: only strings that may change are looked at one by one."""
        parts = text.split('"')  # a string is every second one
        if _BLANKS.search("".join(parts[::2])):
            parts[::2] = [_BLANKS.sub("", part) for part in parts[::2]]
        change = {}
        for clear in set(parts[1::2]):
            secret, clean = secret_key(clear), masked(clear)
            if secret or clean != clear:
                change[clear] = secret, clean
        if not change:
            return '"'.join(parts)
        out, done = [], 0
        for k in [k for k in range(1, len(parts), 2) if parts[k] in change]:
            if k < done:  # in a value that is left out
                continue
            secret, clean = change[parts[k]]
            if not parts[k + 1].startswith(":"):
                if clean != parts[k]:
                    out += [*parts[done:k], quoted(clean)[1:-1]]
                    done = k + 1
            elif secret:
                out += [*parts[done : k + 1], ":", REDACTED]
                done, end = k + 1, 1
                if parts[done] == ":":
                    done, end = k + 3, 0
                elif parts[done][1] in "{[":
                    depth, at = 1, 2
                    while depth:
                        for found in _BRACKET.finditer(parts[done], at):
                            depth += 1 if found[0] in "{[" else -1
                            if not depth:
                                end = found.end()
                                break
                        else:
                            done, at = done + 2, 0
                else:
                    end = _SCALAR_END.search(parts[done], 1).start()
                parts[done] = parts[done][end:]
        return '"'.join([*out, *parts[done:]])

    def plain(token: str) -> str:
        return json.loads(f'"{token}"') if "\\" in token else token

    seen: dict[str, bool] = {}

    def one(text: str | None) -> str | None:
        if text is None or text == "{}":
            return text
        if not sound(text):
            return by_token(text)
        return of_json(text) if "\\" in text else of_plain_json(text)

    def by_token(text: str) -> str:
        grammar, parts, at = _Grammar(), [], 0
        blanks = []
        secret, depth = False, 0  # a value that is left out, and how deep in it the scan is
        while at < len(text):
            found = _TOKEN.match(text, at)
            token, kind, at = found[0], found.lastindex, found.end()
            if kind == 4:
                if not secret:
                    blanks.append(len(parts))
                    parts.append(token)
                continue
            grammar.take('"' if kind in (1, 2) else token)
            grammar.sound &= kind != 2 and (kind != 5 or _BARE.fullmatch(token) is not None)
            if kind == 1 and (colon := _COLON.match(text, at)):
                name = said(token, grammar)
                if not secret:
                    parts += [token, ":"]
                    secret, depth = hidden(name), 0
                    if secret:
                        parts.append(f'"{REDACTED}"')
                grammar.take(":")
                at = colon.end()
                continue
            if secret:
                if kind == 3 and depth == 0 and token in ",}]":  # a value is missing
                    secret = False
                else:
                    depth += (token in "{[") - (token in "}]") if kind == 3 else 0
                    secret = depth > 0
                    continue
            if kind == 1:
                clear = said(token, grammar)
                clean = masked(clear)
                parts.append(token if clean == clear else quoted(clean))
            else:
                parts.append(token)
        if grammar.sound and grammar.due == "nothing":
            for k in blanks:
                parts[k] = ""
            return "".join(parts)
        return quoted(masked("".join(parts)))

    return one


def truncate_document(
    col: Column, max_text: int = MAX_TEXT, max_items: int = MAX_ITEMS, max_depth: int = MAX_DEPTH
) -> Column:
    """Shorten long strings and lists and cut deep nesting, each with a marker of what is gone."""

    def change(document: object) -> object:
        def walk(node: object, depth: int) -> object:
            if depth >= max_depth:
                return f"<Truncated: max depth {max_depth} reached>"
            if isinstance(node, str) and len(node) > max_text:
                return node[:max_text] + f"... <Truncated: {len(node) - max_text} chars omitted>"
            if isinstance(node, dict):
                return {k: walk(v, depth + 1) for k, v in node.items()}
            if isinstance(node, list):
                kept = [walk(item, depth + 1) for item in node[:max_items]]
                if len(node) > max_items:
                    kept.append(f"<Truncated: {len(node) - max_items} items omitted for trace efficiency>")
                return kept
            return node

        return walk(document, 0)

    return F.pandas_udf(_rewrite(change, lambda text: str(change(text))), "string")(col)
