"""License scans by canonical digest, with Spark SQL functions only.

A canonical text has lower case, no copyright lines, one spelling of equivalent words and one space for any run of
other characters. Entire canonical texts are hash-joined by SHA-256 to the digests of known licences; the lines of a
text are joined in the same way, so that a notice line in a longer text is found as well. Only lines whose canonical
length is that of a known text are hashed: a filter that loses nothing.

Cases: a null or empty text has the digest of the empty text and no licence; texts of any length count whole; repeated
rows give repeated results; a digest known under two names has the first of them; extra columns are kept, and columns
named as the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fintally.llm.common import table, written

_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""
# Known licence texts and notices.
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License."""),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.
""" + _WARRANTY),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
""" + _WARRANTY),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
# Equivalent spellings, applied in this order to lower-case text.
SPELLINGS = (("licen[cs]e", "license"), ("sub-license", "sublicense"), ("non-?commercial", "noncommercial"), ("noninfringment", "noninfringement"), ("https?://", "http "), ("v\\. ?([0-9])", "version $1"))
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n]*(copyright|\(c\)|©)([^\p{L}\n][^\n]*)?$"
#: A list of known texts up to this length is broadcast; a longer one is joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Distinct lengths of known texts that are listed in the filter of lines; with more, a line of any length between them is hashed.
BROADCAST_SIZES = 10_000


def canonical(text: Column) -> Column:
    """The canonical text, its lines kept apart by single newlines."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "")
    for old, new in SPELLINGS:
        out = F.regexp_replace(out, old, new)
    out = F.regexp_replace(out, r"[^\p{L}\p{N}\n]+", " ")
    return F.regexp_replace(F.regexp_replace(out, r" *\n[ \n]*", "\n"), r"^[ \n]+|[ \n]+$", "")


def digest(canonical_text: Column) -> Column:
    return F.sha2(F.translate(canonical_text, "\n", " "), 256)


def known_digests(spark: SparkSession, known: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    """(license, digest, size) of known texts, each digest once."""
    rows = spark.createDataFrame([*known], "license string, known string").select("license", canonical(F.col("known")).alias("c"))
    return rows.groupBy(digest(F.col("c")).alias("digest")).agg(F.min("license").alias("license"), F.min(F.length("c")).alias("size")).where("size > 0")


def scanned(df: DataFrame, known: DataFrame, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (default: all) of df with digest, license (of the entire text, else null), line_licenses (comma-joined) and n_license_lines.

    Texts are made canonical once: their digests, and those of their fitting lines, are written to the shared folder.
    """
    results = {"digest", "license", "line_licenses", "n_license_lines"}
    kept = [c for c in keep or df.columns if c not in results]
    small = known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    listed = F.broadcast(known) if small else known
    # the lengths of known texts; where there are too many to list, only the range that they span
    lengths = known.select("size").distinct()
    sizes = [r[0] for r in lengths.limit(BROADCAST_SIZES + 1).collect()]
    least, most = (0, -1) if not sizes else known.agg(F.min("size"), F.max("size")).first()
    of_known = lambda n: n.isin(sizes) if len(sizes) <= BROADCAST_SIZES else n.between(least, most)
    row = df.select(*kept, canonical(F.col(text_col)).alias("_text"))
    fits = F.filter(F.transform(F.split("_text", "\n"), lambda line, i: F.struct(i.alias("at"), line.alias("line"))), lambda x: of_known(F.length(x["line"])))
    row = written(row.select(*kept, digest(F.col("_text")).alias("digest"), F.transform(fits, lambda x: F.struct(x["at"].alias("at"), digest(x["line"]).alias("of"))).alias("_lines")))
    # lines are looked up once for each distinct list of them; rows without any take no part in that join
    with_lines, none = row.where(F.size("_lines") > 0).withColumn("_key", F.sha2(F.to_json("_lines"), 256)), row.where(F.size("_lines") == 0)
    lines = with_lines.select("_key", "_lines").dropDuplicates(["_key"]).select("_key", F.inline("_lines"))
    found = lines.join(listed.select(F.col("digest").alias("of"), "license"), "of").groupBy("_key")
    found = found.agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("line_licenses"), F.count("*").alias("n_license_lines"))
    out = with_lines.drop("_lines").join(found, "_key", "left").drop("_key")
    out = out.unionByName(none.drop("_lines").withColumns({"line_licenses": F.lit(None).cast("string"), "n_license_lines": F.lit(None).cast("long")}))
    out = out.join(listed.select("digest", "license"), "digest", "left")
    return out.select(*kept, "digest", "license", F.coalesce("line_licenses", F.lit("")).alias("line_licenses"), F.coalesce("n_license_lines", F.lit(0)).cast("long").alias("n_license_lines"))


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, digest, license, line_licenses and n_license_lines of every document."""
    found = scanned(table(spark, sf_dir, "documents").select("doc_id", "text"), known_digests(spark), keep=["doc_id"])
    return found.select("doc_id", "digest", "license", "line_licenses", "n_license_lines")


def _sql_canonical(text: str) -> str:
    out = f"regexp_replace(lower(coalesce({text}, '')), '{COPYRIGHT_LINE}', '', 'g')"
    for old, new in SPELLINGS:
        out = f"regexp_replace({out}, '{old}', '{new.replace('$1', chr(92) + '1')}', 'g')"
    out = f"regexp_replace({out}, '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"
    return f"regexp_replace(regexp_replace({out}, ' *\\n[ \\n]*', chr(10), 'g'), '^[ \\n]+|[ \\n]+$', '', 'g')"


ORACLE_SQL = f"""
WITH raw(license, known) AS (VALUES {", ".join("('" + n + "', '" + t.replace("'", "''") + "')" for n, t in KNOWN)}),
k AS (SELECT sha256(replace(c, chr(10), ' ')) AS digest, min(license) AS license FROM (SELECT license, {_sql_canonical("known")} AS c FROM raw) WHERE length(c) > 0 GROUP BY 1),
d AS (SELECT doc_id, {_sql_canonical("text")} AS c FROM documents),
l AS (SELECT doc_id, sha256(unnest(string_split(c, chr(10)))) AS digest FROM d),
f AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS line_licenses, count(*) AS n FROM l JOIN k USING (digest) GROUP BY doc_id)
SELECT d.doc_id, sha256(replace(d.c, chr(10), ' ')) AS digest, k.license, coalesce(f.line_licenses, '') AS line_licenses, coalesce(f.n, 0)::BIGINT AS n_license_lines
FROM d LEFT JOIN k ON k.digest = sha256(replace(d.c, chr(10), ' ')) LEFT JOIN f ON f.doc_id = d.doc_id
"""
