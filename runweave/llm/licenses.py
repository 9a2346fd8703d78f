"""License scans by canonical digests; DataFrame functions only.

A text is brought into a canonical form: lower case, copyright lines gone, equivalent spellings made one, everything
but letters and digits a blank. The SHA-256 of the whole canonical text is looked up in a hash join among digests of
known licences, whose number is fixed, and so are the digests of its lines among those of known one-line notices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import no_clash

#: Equivalent spellings, each replaced by the second form (fixed values).
SPELLINGS = (
    ("licence", "license"), ("sub-license", "sublicense"), ("non-commercial", "noncommercial"), ("copyright owner", "copyright holder"),
    ("organis", "organiz"), ("authoris", "authoriz"), ("recognis", "recogniz"), ("favour", "favor"), ("judgement", "judgment"),
    ("fulfilment", "fulfillment"), ("analogue", "analog"), ("per cent", "percent"), ("https://", "http://"), ("&", " and "),
)

_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n{first}Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n{second}Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n{third}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_THIRD = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
_MIT = f"{_GRANT}, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC_END = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
#: Whole licence texts by their public identifiers (fixed values), with and without their title line.
TEXTS = {
    "MIT": ("MIT License", _MIT),
    "ISC": ("ISC License", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_END}"),
    "0BSD": ("BSD Zero Clause License", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n{_ISC_END}"),
    "BSD-2-Clause": ("BSD 2-Clause License", _BSD.format(first="1. ", second="2. ", third="")),
    "BSD-3-Clause": ("BSD 3-Clause License", _BSD.format(first="1. ", second="2. ", third=f"3. {_THIRD}")),
    "Zlib": ("zlib License", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."),
    "Unlicense": ("The Unlicense", "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org>"),
}
#: Canonical digests of the standard wordings of long licences (fixed values).
DIGESTS = {
    "Apache-2.0": "d2a0635c24237c277a8353d9c1b79d252ec62ac2ab89b28b3deceb8b58ca13e3",
    "Artistic-1.0-Perl": "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702",
    "BSD-3-Clause-UC": "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651",
    "CC0-1.0": "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
    "GFDL-1.2": "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60",
    "GFDL-1.3": "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826",
    "GPL-1.0": "9e12a40a9b22c45d116f19e1746b08ea0b853519de3e03ceb780f2a36d5f388c",
    "GPL-2.0": "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821",
    "GPL-3.0": "093bb37bff6533bc1f91f57d671e3e2cc9e4e27afc1293808fddc861a6d15329",
    "LGPL-2.0": "148f4708fdb34267f108b3467504e464cf0c00e2c6b6ebafc1a45e2e5c4506b9",
    "LGPL-2.1": "c3acda00b8ee9c98becbe30fce8f159cc6a985b3b9dc521e37d9ab2f241463b2",
    "LGPL-3.0": "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    "MPL-1.1": "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6",
    "MPL-2.0": "6fedd8db6adb0e102fc0f69b9e1501d2edaf25940e34910831cab46f9f5d4e4d",
}
#: Lines of the usual file headers, which name their licence (fixed values).
HEADERS = {
    "Apache-2.0": ('Licensed under the Apache License, Version 2.0 (the "License");', 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', 'Licensed under the Apache License, Version 2.0 (the "License"); you may not'),
    "GPL-3.0": ("the Free Software Foundation, either version 3 of the License, or",),
    "GPL-2.0": ("the Free Software Foundation; either version 2 of the License, or", "the Free Software Foundation, either version 2 of the License, or"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    "MIT": ("Use of this source code is governed by an MIT-style license that can be", "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file."),
    "BSD-3-Clause": ("Use of this source code is governed by a BSD-style license that can be", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
}
#: Names under which one-line notices mention a licence (fixed values).
NAMES = {
    "MIT": ("MIT License", "MIT"), "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GPL-3.0", "GPLv3"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GPL-2.0", "GPLv2"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "LGPL-3.0"), "AGPL-3.0": ("GNU Affero General Public License, version 3", "AGPL-3.0"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL-2.0"), "BSD-3-Clause": ("BSD 3-Clause License", "BSD-3-Clause"),
    "BSD-2-Clause": ("BSD 2-Clause License", "BSD-2-Clause"), "ISC": ("ISC License", "ISC"), "Unlicense": ("Unlicense",),
    "CC0-1.0": ("CC0 1.0", "CC0-1.0"), "CC-BY-4.0": ("CC BY 4.0", "CC-BY-4.0"), "CC-BY-SA-4.0": ("CC BY-SA 4.0", "CC-BY-SA-4.0"), "CC-BY-NC-4.0": ("CC BY-NC 4.0", "CC-BY-NC-4.0"),
}
#: Forms of one-line notices.
FORMS = ("Licensed under {0}", "Licensed under the {0}", "Released under {0}", "Released under the {0}", "Distributed under the {0}", "This work is licensed under {0}", "This work is licensed under the {0}", "This software is licensed under the {0}", "SPDX-License-Identifier: {0}")


def canonical_lines(text: Column) -> Column:
    """The canonical lines of a text, blank ones left out: array<string>; null gives an empty array."""
    c = F.lower(F.coalesce(text, F.lit("")))
    c = F.regexp_replace(c, r"(?m)^(?:(?!\(c\))[^\p{L}\p{N}\n©])*+(?:copyright\b(?! ?(?:holder|owner|notice))|\(c\) ?(?:copyright|\d{4})|©|all rights reserved)[^\n]*", "")
    for old, new in SPELLINGS:
        c = F.replace(c, F.lit(old), F.lit(new))
    c = F.regexp_replace(c, r"[^\p{L}\p{N}\n]++", " ")
    return F.filter(F.transform(F.split(c, "\n"), lambda line: F.trim(line)), lambda line: line != "")


def digest_of(lines: Column) -> Column:
    return F.sha2(F.array_join(lines, " "), 256)


def known(spark: SparkSession) -> DataFrame:
    """license, digest, chars (canonical length), whole boolean: digests of whole licences and of notices, each once.

    Its size is that of the tables above: a few hundred rows.
    """
    rows = [(name, form, True) for name, (title, body) in TEXTS.items() for form in (body, f"{title}\n\n{body}")]
    rows += [(name, form.format(alias), False) for name, aliases in NAMES.items() for alias in aliases for form in FORMS]
    rows += [(name, line, False) for name, headers in HEADERS.items() for line in headers]
    lines = canonical_lines(F.col("text"))
    literals = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(text).alias("text"), F.lit(whole).alias("whole")) for name, text, whole in rows])
    table = spark.range(1).select(F.explode(literals).alias("k")).select("k.*").select("license", "whole", digest_of(lines).alias("digest"), F.length(F.array_join(lines, " ")).alias("chars"))
    fixed = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(True).alias("whole"), F.lit(digest).alias("digest"), F.lit(None).cast("int").alias("chars")) for name, digest in DIGESTS.items()])
    table = table.unionByName(spark.range(1).select(F.explode(fixed).alias("k")).select("k.*"))
    return table.groupBy("digest", "whole").agg(F.min("license").alias("license"), F.max("chars").alias("chars"))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, digest string, license string, n_notices long, notices string for each row of df.

    digest: SHA-256 of the canonical form of the whole text. license: the known licence with that digest, or null.
    notices: the licences of lines that are known one-line notices, distinct, ascending, comma-joined ('' for none);
    n_notices: such lines, repeats included. Null and empty texts have the digest of the empty text and no licence.
    Repeated rows and null ids stay. Further columns of df, whatever their names, do not matter; id_col by the name of
    an output is an error (ValueError).
    """
    no_clash([id_col], "digest", "license", "n_notices", "notices")
    table = known(df.sparkSession)
    notices = table.where("not whole").select("digest", "license", "chars").collect()  # a few hundred fixed rows
    lines = canonical_lines(F.col(text_col))
    rows = df.select(F.col(id_col).alias("id"), lines.alias("lines"))
    lengths = sorted({row["chars"] for row in notices})
    names = F.create_map(*[F.lit(x) for row in notices for x in (row["digest"], row["license"])])
    short = F.filter("lines", lambda line: F.length(line).isin(lengths))
    found = F.filter(F.transform(short, lambda line: F.element_at(names, F.sha2(line, 256))), lambda name: name.isNotNull())
    rows = rows.select("id", digest_of(F.col("lines")).alias("digest"), found.alias("found"))
    whole = F.broadcast(table.where("whole").select("digest", "license"))
    return rows.join(whole, "digest", "left").select(F.col("id").alias(id_col), "digest", "license", F.size("found").cast("long").alias("n_notices"), F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("notices"))
