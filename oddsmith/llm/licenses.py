"""License scans: canonical digest lookup [native].

A text's lines are lower-cased, each run of anything but letters and digits
becomes a space, equivalent spellings become one, and copyright lines go. The
SHA-256 of what is left, as one line, is the text's canonical digest; it is
hash-joined to the digests of known licence texts. Every single line is looked
up as a text of its own too, as licence notices stand between other lines.

The known texts are a parameter; their digests, MOST_KNOWN at most, are
broadcast. Null text counts as empty; no text left means no licence. Each input
row gives a row; repeated rows alike. Other columns are ignored. An empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_KNOWN = 10_000

#: Spellings that count as equal in licence texts, as published with the SPDX matching guidelines (by stem).
EQUIVALENT = [("licenc", "licens"), ("isation", "ization"), ("organis", "organiz"), ("authoris", "authoriz"), ("recognis", "recogniz"), ("utilis", "utiliz"), ("analys", "analyz"), ("acknowledgem", "acknowledgm"), ("fulfilm", "fulfillm"), ("favour", "favor"), ("whilst", "while"), ("sublicens", "sub licens"), ("non commercial", "noncommercial"), ("https", "http")]
COPYRIGHT = r"^(copyright|all rights reserved|c [0-9]{4})( |$)"

#: Short licences and usual notices.
KNOWN = {
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT-notice": "Released under the MIT License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC0-1.0": "This work is dedicated to the public domain under CC0 1.0.",
}


def _line(line: Column) -> Column:
    out = F.trim(F.regexp_replace(line, r"[^\p{L}\p{N}]+", " "))
    for a, b in EQUIVALENT:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.when(out.rlike(COPYRIGHT), "").otherwise(out)


def canonical_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), "\n", -1), _line), lambda x: x != "")


def canonical(text: str) -> str:
    """The same for a known text, on the driver."""
    out = []
    for line in text.lower().split("\n"):
        line = re.sub(r"[\W_]+", " ", line).strip(" ")
        for a, b in EQUIVALENT:
            line = line.replace(a, b)
        if line and not re.search(COPYRIGHT, line):
            out.append(line)
    return " ".join(out)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", known: dict[str, str] | None = None) -> DataFrame:
    """(key, canonical_sha256, license_id, notice_ids) of each row; notice_ids: sorted, of single lines."""
    known = KNOWN if known is None else known
    if len(known) > MOST_KNOWN:
        raise ValueError(f"more than {MOST_KNOWN} known licences would be broadcast")
    digest = {}
    for name in sorted(known):
        if body := canonical(known[name]):
            digest.setdefault(hashlib.sha256(body.encode()).hexdigest(), name)
    table = docs.sparkSession.createDataFrame(list(digest.items()), "__digest string, license_id string")
    lines = docs.select(F.col(key).alias("key"), canonical_lines(F.col(text)).alias("lines"))
    hashed = lines.select("key", F.sha2(F.array_join("lines", " "), 256).alias("canonical_sha256"), F.array_intersect(F.transform("lines", lambda x: F.sha2(x, 256)), F.array(*map(F.lit, digest))).alias("hits"))
    names = F.create_map(*[F.lit(x) for pair in digest.items() for x in pair])
    found = hashed.join(F.broadcast(table), F.col("canonical_sha256") == F.col("__digest"), "left")
    return found.select(F.col("key").alias(key), "canonical_sha256", "license_id", F.array_sort(F.transform("hits", lambda h: names[h])).alias("notice_ids"))
