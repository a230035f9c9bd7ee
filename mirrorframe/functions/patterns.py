"""Text made from a counter by a pattern: `#` is a digit, `?` a small letter, `^` a capital, anything else itself."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from mirrorframe.functions.permutation import permuted

# What the placeholders stand for.
ALPHABETS = {"#": "0123456789", "?": "abcdefghijklmnopqrstuvwxyz", "^": "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}

# A beginning, and what follows it, by kind of personal data.
PERSONAL = {
    "email": ("user.", "????####@example.com"),
    "phone_number": ("+000 ", "## ### ####"),
    "credit_card_number": ("0000", "############"),
    "ssn": ("000-", "##-####"),
    "name": ("Name ", "^?????"),
    "first_name": ("First ", "^?????"),
    "last_name": ("Last ", "^?????"),
    "address": ("Plot ", "#### ^????? Street"),
    "street_address": ("Plot ", "#### ^????? Street"),
    "city": ("Town ", "^?????"),
    "postcode": ("00-", "#####"),
    "ipv4_address": ("192.0.2.", "###"),
    "user_name": ("user_", "????####"),
}
# More of these are put in front of the body until the pattern has as many values as are asked for.
LENGTHENED_BY = "#"
# Numbers are exact up to here (52 bits of a hash choose among them).
MOST = 1 << 52


@dataclass(frozen=True)
class Pattern:
    """`lead` as it stands, then `body` with its placeholders filled in."""

    lead: str
    body: str

    @property
    def capacity(self) -> int:
        size = 1
        for char in self.body:
            size *= len(ALPHABETS.get(char, "x"))
        return size

    def holding(self, n: int) -> Pattern:
        """This pattern, lengthened until it has `n` values."""
        out = self
        while out.capacity < n:
            out = Pattern(out.lead, LENGTHENED_BY + out.body)
        return out

    def text(self, number: Column) -> Column:
        """The value of a number below the capacity; different numbers have different values."""
        parts, literal, left = [], "", number.cast("bigint")
        size = min(self.capacity, MOST)
        for char in self.body:
            if char not in ALPHABETS:
                literal += char
                continue
            letters = ALPHABETS[char]
            size = max(size // len(letters), 1)
            place = (F.floor(left / F.lit(size)) % len(letters)).cast("int")
            if literal:
                parts.append(F.lit(literal))
                literal = ""
            parts.append(F.substring(F.lit(letters), place + 1, F.lit(1)))
        if literal:
            parts.append(F.lit(literal))
        return F.concat(F.lit(self.lead), *parts)


def made(pattern: Pattern, seed: int | str, stream: str, counter: Column, n: int) -> Column:
    """Different values for the counters 0 .. n-1, in no visible order."""
    wide = pattern.holding(n)
    # The counters are spread over all values that the pattern has.
    step = max(min(wide.capacity, MOST) // max(n, 1), 1)
    return wide.text(permuted(seed, stream, counter, max(n, 1)) * F.lit(step))
