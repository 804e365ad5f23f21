"""License scans by canonical digest.

A text is reduced to what license texts have in common across copies: letters in lower case, no
copyright statements, one spelling of equivalent words, single blanks instead of punctuation. Its SHA-256
is joined to the digests of known license texts. Each line is looked up in the same way among known
notices ("Released under the MIT License."). The known digests are a fixed table of a few dozen rows,
so the join is a broadcast and nothing is shuffled.

Defined cases: a NULL or empty text has the digest of the empty text and no license; NULL and repeated
ids are rows like any other; extra columns are left out; an empty table has no rows; a text of any
length is digested whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailstrata.llm.common import named

_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission.
"""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF
USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED
OF THE POSSIBILITY OF SUCH DAMAGE."""
#: Whole license texts (fixed values, the public texts).
TEXTS = (
    ("MIT", f"""MIT License
Copyright (c) <year> <copyright holders>
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
{_WARRANTY}"""),
    ("ISC", f"""ISC License
Copyright (c) <year> <owner>
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.
{_ISC}"""),
    ("0BSD", f"""Copyright (c) <year> <owner>
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
{_ISC}"""),
    ("BSD-2-Clause", f"Copyright (c) <year> <owner>\n{_BSD}{_BSD_END}"),
    ("BSD-3-Clause", f"Copyright (c) <year> <owner>\n{_BSD}{_BSD_THIRD}{_BSD_END}"),
    ("Zlib", """zlib License
Copyright (c) <year> <owner>
This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for
any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you
use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
)
#: Digests of whole texts too long to stand here, by canonical() of Debian's copies (/usr/share/common-licenses). The
#: SQL does not have them. Unlicense, BSL, CC BY and other texts are missing: no copy was at hand to take a digest from.
DIGESTS = (
    ("Apache-2.0", "75acde0fb516a7ba4597dfc23680cf78281f7fae7f3b74a78e06ef83c1c375c6"),
    ("Artistic-1.0-Perl", "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b"),
    ("GFDL-1.3", "2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d"),
    ("GPL-1.0", "e80b630fa4f92f7da9cffbd75699f62bfac51ce5b33da44e74b5acc53e5187f6"),
    ("GPL-2.0", "ada43b21b16dd64b4b8f1d9c2ab43ff16f75a8f0f835fc2f37a0c7e65f28d243"),
    ("GPL-3.0", "274362af652e77e6f0b95849b862c8080691fdb958ffa1c562be7710f3ee74db"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "d35837e2a25aa463ef610d84a745dd508a3e9c1424ea611c4c5939307e738d63"),
    ("MPL-2.0", "4e3ed3db421caff5beab12d8b5ed5c6f8edb888f5430801b1624448d4d7f04fe"),
)
#: Notices of one line (fixed values); each holds a word of HINT.
NOTICES = (
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"), ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
)
HINT = "(?i)licen[sc]e"

#: (pattern, replacement) in order, in the common part of both engines' syntax.
STEPS = (
    (r"(^|\n)[^\n]*copyright[ \t]+(\(c\)|©|[0-9<\[])[^\n]*", r" "),
    (r"all rights reserved", " "),
    (r"licence", "license"), (r"sub[- ]licens", "sublicens"), (r"merchantibility", "merchantability"),
    (r"acknowledgement", "acknowledgment"), (r"non[- ]infring", "noninfring"), (r"and/or", "and or"),
    (r"https", "http"), (r"favour", "favor"), (r"organis", "organiz"), (r"behaviour", "behavior"),
    (r"(^|\n)[ \t]*(the )?(mit|isc|zlib) license( \([a-z]+\))?[ \t]*(\n|$)", " "),
    (r"[^\p{L}\p{N}]+", " "),
)
#: What a license text goes on with behind its copyright statement.
_OPENING = (r"(?:permission (?:is hereby granted|to use)|redistribution and use|this software is provided|all rights reserved"
            r"|licen[cs]ed under|released under|this work is licen[cs]ed|spdx-license-identifier|everyone is permitted)")
#: Starts of a copyright statement; "copyright notice", "copyright holders" and the item (c) of a list are none.
_MARK = (r"(?:copyright[ \t]*(?:\(c\)|©)|copyright[ \t]+(?=[0-9<\[])|\(c\)[ \t]*(?=[0-9<\[])|©"
         r"|(?<![^\n])[ \t]*copyright[ \t]+(?!notice|holder|owner|law|licen|statement|(?:and|or|in|of|by|is|as|to|for)\b))")
#: STEPS without their first, which takes a whole line: a statement ends at a known opening or its line's end within
#: 200 characters, else behind the years. A title may stand on the line of the opening.
WHOLE_STEPS = (
    (rf"{_MARK}(?:[^\n]{{0,200}}?(?=[ \t]*(?:{_OPENING}|\n|\z))|[0-9, \t–-]{{0,60}})", " "),
    *STEPS[1:-2],
    (rf"(^|\n)[ \t]*(the )?(mit|isc|zlib) license( \([a-z]+\))?[ \t.,:]*(?={_OPENING})", " "),
    *STEPS[-2:],
)


def canonical(text: Column) -> Column:
    out = F.lower(F.coalesce(text, F.lit("")))
    for pattern, new in WHOLE_STEPS:
        out = F.regexp_replace(out, pattern, new)
    return F.trim(out)


def canonical_sql(text: str) -> str:
    """``canonical`` for DuckDB, but for copyright statements: its first step takes their whole line."""
    out = f"lower(coalesce({text}, ''))"
    for pattern, new in STEPS:
        out = f"regexp_replace({out}, '{pattern}', '{new}', 'g')"
    return f"trim({out})"


def known(spark, texts: tuple[tuple[str, str], ...]) -> dict[str, str]:
    """Digest to license of a fixed table."""
    frame = spark.createDataFrame(list(texts), "license_id string, body string")
    return {r[0]: r[1] for r in frame.select(F.sha2(canonical(F.col("body")), 256), "license_id").collect()}


def scan(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, digest, license_id, notice_ids, n_notices) per row; notice_ids are sorted, comma-separated."""
    spark = df.sparkSession
    whole = known(spark, TEXTS) | {digest: name for name, digest in DIGESTS}
    texts = spark.createDataFrame(list(whole.items()), "digest string, license_id string")
    notices = known(spark, NOTICES)
    lookup = F.create_map(*[F.lit(x) for item in notices.items() for x in item])
    text = named(text_column).cast("string")
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: line.rlike(HINT))
    found = F.filter(F.transform(lines, lambda line: lookup[F.sha2(canonical(line), 256)]), lambda x: x.isNotNull())
    rows = df.select(named(id_column).cast("long").alias("doc_id"), F.sha2(canonical(text), 256).alias("digest"),
                     found.alias("found"))
    return rows.join(F.broadcast(texts), "digest", "left").select(
        "doc_id", "digest", "license_id", F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("notice_ids"),
        F.size("found").cast("long").alias("n_notices"))
