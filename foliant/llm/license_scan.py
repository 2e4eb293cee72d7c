"""Whole-text licence lookup by canonical digests; DataFrame functions only.

A text is canonical after: lower case; copyright notices dropped; everything but letters and digits turned to single spaces; equivalent spellings made
one. Its SHA-256 digest is joined with the digests of known licence texts, so only a text that is a licence as a whole is found.

A notice is a mark (`copyright`, `(c)`, `©`) with a year or a second mark, and what follows: up to words that begin a grant, however many holders are named before them,
if no other sentence stands between than further notices and `all rights reserved`, so that neither a joined nor a wrapped text matters; else the rest of its line if it begins the line. A first line that begins with `copyright` is one too, and
`all rights reserved` goes anywhere. Other sentences that speak of copyright stay, wherever lines break.

Cases: null, empty and blank texts, and texts of notices only, are canonically empty and match nothing; repeated rows are each
returned; of two known licences with one canonical text the smaller name is given; an empty table gives an empty result; other columns
are ignored. Distinct digests are joined, so copies in any number cost one row a task. Known digests are broadcast only if counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import let

BROADCAST_LICENCES = 100_000

# Marks of a notice, words that begin a grant, and a phrase without meaning for the licence.
_SIGN = r"(?:copyright|\(c\)|©)"
_YEAR = r"(?:[12][0-9]{3}|<years?>|\[yyyy\])"
MARK = rf"{_SIGN}(?:\s*{_SIGN})*\s*{_YEAR}|{_SIGN}(?:\s*{_SIGN})+"
GRANTS = r"permission |redistribution |licensed |released |distributed |use of this |this (?:software|work|program|is|license|licence|library|source)|the above |to the extent |everyone is |you may |unless |boost software |apache license|mit license|bsd |isc license|zlib license|mozilla ".replace(" ", r"\s+")
RESERVED = "all rights reserved"
# Words whose full stop ends no sentence; so does that of a single letter.
SHORT = "inc|ltd|co|corp|llc|gmbh|jr|sr|dr|mr|mrs|ms|st|bros|al|dept|univ|[a-z]"
NOTICE = rf"(?:{MARK})\S*[^.!?]*"
JOINED = rf"{NOTICE}?(?:[.!?]\s+(?:{RESERVED}|{NOTICE}))*[.!?]?\s+({GRANTS})"

# Spellings that licence matching guidelines treat as one, as (canonical words, replacement).
SPELLINGS = [
    ("licence", "license"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("catalogue", "catalog"),
    ("centre", "center"),
    ("favour", "favor"),
    ("favourite", "favorite"),
    ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("modelling", "modeling"),
    ("non commercial", "noncommercial"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("per cent", "percent"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("sub license", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("copyright owner", "copyright holder"),
    ("https", "http"),
]

# Whole texts of short licences and of the usual one-line grants.
LICENCES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.""",
    "MIT-line": "Released under the MIT License.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSL-1.0": """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software, and to prepare derivative works of the
Software, and to permit third-parties to whom the Software is furnished to
do so, all subject to the following:

The copyright notices in the Software and this entire statement, including
the above license grant, this restriction and the following disclaimer,
must be included in all copies of the Software, in whole or in part, and
all derivative works of the Software, unless such copies or derivative
works are solely in the form of machine-executable object code generated by
a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT
SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE
FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.

In jurisdictions that recognize copyright laws, the author or authors
of this software dedicate any and all copyright interest in the
software to the public domain. We make this dedication for the benefit
of the public at large and to the detriment of our heirs and
successors. We intend this dedication to be an overt act of
relinquishment in perpetuity of all present and future rights to this
software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR
OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <http://unlicense.org/>""",
    "Zlib": """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software. If you use this software
   in a product, an acknowledgment in the product documentation would be
   appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be
   misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "GPL-3.0-line": "Distributed under the GNU General Public License, version 3.",
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0-line": "To the extent possible under law, the author has dedicated all copyright to the public domain worldwide.",
    "BSD-3-Clause-line": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MPL-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
}

# Digests of the canonical forms of whole texts that are too long to list here.
DIGESTS = {
    "Apache-2.0": "036b5ff6d47b44974c624da95e5bf0ac7ddfe5030e41dfa7ff8ac0c1daa9f32b",
    "Artistic-1.0-Perl": "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702",
    "CC0-1.0": "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
    "GFDL-1.2": "f416312175fb5ff91a3e261e92c7c7bbb67fac12942bd339a60c8f95d1c6c974",
    "GFDL-1.3": "19cac36ea8529518168d682c289ece709d150829da6677b208325faa1b8904d6",
    "GPL-1.0": "1515b5933db6b272c9708ddda2022a6314b460864e6b2f558746e9ecee1edd63",
    "GPL-2.0": "3702cb120574e872bcd6e7263adf5acfc6c8605d799b8f1ce40cc2de836d0a0e",
    "GPL-3.0": "1c5db3a9706da330620b6cba254c3d98d654fc625c04908e63e64d0ade6861e3",
    "LGPL-2.0": "4401e0261a8caf4fd55eeb0e816fda06bbc9e4b2605767f5ffdf843a5c70e07e",
    "LGPL-2.1": "599d9303049b507aa89582ee08dd4ddaba298764648558e7bf8e78309807bfaa",
    "LGPL-3.0": "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    "MPL-1.1": "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6",
    "MPL-2.0": "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a",
}
# Titles that some texts are published under.
TITLES = {
    "0BSD": "BSD Zero Clause License",
    "BSD-2-Clause": "BSD 2-Clause License",
    "BSD-3-Clause": "BSD 3-Clause License",
    "ISC": "ISC License",
    "MIT": "MIT License",
    "Unlicense": "The Unlicense",
    "Zlib": "zlib License",
}


def _notices_dropped(low: Column) -> Column:
    # Stops that end no sentence become blanks, which the canonical form has in their place anyway.
    bare = F.regexp_replace(F.regexp_replace(low, r"[.!?](\S)", " $1"), rf"(^|[^\p{{L}}\p{{N}}])({SHORT})\.", "$1$2 ")
    joined = F.regexp_replace(bare, JOINED, " $1")
    lines = F.regexp_replace(joined, rf"(?md)^[ \t#*/;-]*(?:{MARK})[^\n]*$", " ")
    return F.regexp_replace(lines, r"^\s*copyright [^\n]*\n", " ")


def _phrase(phrase: str, by: str):
    return lambda x: F.when(F.contains(x, F.lit(phrase)), F.regexp_replace(x, f"(?<![^ ]){phrase}(?![^ ])", by)).otherwise(x)


def canonical(text: Column) -> Column:
    """The canonical form. Regular expressions that few texts need run only on those that have the words for it."""
    low = F.lower(F.coalesce(text, F.lit("")))
    signs = lambda x: F.contains(x, F.lit("copyright")) | F.contains(x, F.lit("(c)")) | F.contains(x, F.lit("©"))
    bare = let(low, lambda x: F.when(signs(x), _notices_dropped(x)).otherwise(x))
    words = F.trim(F.regexp_replace(bare, r"[^\p{L}\p{N}]+", " "))
    single = [(a, b) for a, b in SPELLINGS if " " not in a]
    known = F.create_map(*(F.lit(x) for pair in single for x in pair))
    guard = "(?:^| )(?:" + "|".join(a for a, _ in single) + ")(?: |$)"
    one = let(words, lambda x: F.when(x.rlike(guard), F.array_join(F.transform(F.split(x, " "), lambda w: F.coalesce(known[w], w)), " ")).otherwise(x))
    for a, b in [(RESERVED, ""), *((a, b) for a, b in SPELLINGS if " " in a)]:
        one = let(one, _phrase(a, b))
    return F.trim(let(one, lambda x: F.when(F.contains(x, F.lit("  ")), F.regexp_replace(x, " +", " ")).otherwise(x)))


def digest(text: Column) -> Column:
    """SHA-256 of the canonical form; null if that is empty."""
    return let(canonical(text), lambda x: F.when(x != "", F.sha2(x, 256)))


def known(spark: SparkSession) -> DataFrame:
    """(license_id, digest) of the listed licences."""
    titled = [(k, f"{t}\n\n{LICENCES[k]}") for k, t in sorted(TITLES.items())]
    texts = spark.createDataFrame([*sorted(LICENCES.items()), *titled], "license_id string, text string").select("license_id", digest(F.col("text")).alias("digest"))
    return texts.unionByName(spark.createDataFrame(sorted(DIGESTS.items()), "license_id string, digest string"))


def scan(docs: DataFrame, licences: DataFrame) -> DataFrame:
    """(doc_id, digest, license_id) for each row: digest of the canonical text, licence it is as a whole, or null. `licences`: (license_id, digest)."""
    rows = docs.select("doc_id", digest(F.col("text")).alias("digest"))
    listed = licences.where("digest IS NOT NULL").groupBy("digest").agg(F.min("license_id").alias("license_id"))
    small = listed.limit(BROADCAST_LICENCES + 1).count() <= BROADCAST_LICENCES
    return rows.join(F.broadcast(listed) if small else listed, "digest", "left").select("doc_id", "digest", "license_id")
