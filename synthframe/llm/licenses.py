"""License scans by sentence rules, in DataFrame functions only.

A text is cut into sentences, each is normalised, and known license sentences turn into identifiers; ordered rules over
the sequence of identifiers then name the licenses, each using up the sentences it has matched. Sentences are cut twice,
with line ends as borders and with lines joined into paragraphs, so that wrapped licenses and single lines are both seen.
Everything is one projection: no shuffle, no Python. Texts without a word that every known sentence has one of are not cut
up at all."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read

# Every known sentence has one of these words, in either case. None has white space, which texts break at.
TRIGGERS = ("licen", "copyright", "permission", "warrant", "redistribut", "domain")

# Known sentences by identifier, as public license texts have them; {v} stands for each listed version.
_FREE = "this {work} is free software{mark} you can redistribute it and/or modify it under the terms of the gnu {name} as published by the free software foundation{stop} either version {v} of the license, or (at your option) any later version"
_ONLY = "this {work} is free software{mark} you can redistribute it and/or modify it under the terms of the gnu {name} version {v} as published by the free software foundation"
_HOPE = "this {work} is distributed in the hope that it will be useful, but without any warranty"
_EVEN = _HOPE + "; without even the implied warranty of merchantability or fitness for a particular purpose"
_RECEIVED = "you should have received a copy of the gnu {name} along with this {work}"
_FAMILY = {"GPL": "general public license", "LGPL": "lesser general public license", "AGPL": "affero general public license"}


def _free(family: str) -> tuple[str, ...]:
    return tuple(_FREE.format(work=w, mark=m, stop=s, name=_FAMILY[family], v="{v}") for w in ("program", "library") for m in (":", ";") for s in (",", ";"))


def _only(family: str) -> tuple[str, ...]:
    return tuple(_ONLY.format(work=w, mark=m, name=_FAMILY[family], v="{v}") for w in ("program", "library") for m in (":", ";"))


_VERSIONED = {
    "GPL{v}": ((1, 2, 3), ("this work is licensed under the gnu general public license, version {v}", "licensed under the gnu general public license version {v}", "licensed under the gpl version {v}", "licensed under the gpl v{v}", "released under the gnu general public license, version {v}", *_only("GPL"))),
    "GPL{v}ref": ((1, 2, 3), _free("GPL")),
    "LGPL{v}": (("2.1", 3), ("licensed under the gnu lesser general public license, version {v}", "this work is licensed under the gnu lesser general public license, version {v}", *_only("LGPL"))),
    "LGPL{v}ref": (("2.1", 3), _free("LGPL")),
    "AGPL{v}": ((3,), ("licensed under the gnu affero general public license, version {v}", "this work is licensed under the gnu affero general public license, version {v}", *_only("AGPL"))),
    "AGPL{v}ref": ((3,), _free("AGPL")),
    "Apache{v}": (("1.1", "2.0"), ("licensed under the apache license, version {v}", "licensed under the apache license, version {v} (the \"license\")", "this work is licensed under the apache license, version {v}", "the asf licenses this file to you under the apache license, version {v} (the \"license\")")),
    "MPL{v}": (("1.1", "2.0"), ("this source code form is subject to the terms of the mozilla public license, v. {v}", "this source code form is subject to the terms of the mozilla public license, v. {v}. if a copy of the mpl was not distributed with this file, you can obtain one at http://mozilla.org/mpl/{v}/", "this source code form is subject to the terms of the mozilla public license, v. {v}. if a copy of the mpl was not distributed with this file, you can obtain one at https://mozilla.org/mpl/{v}/", "licensed under the mozilla public license, version {v}")),
    "EPL{v}": (("1.0", "2.0"), ("this program and the accompanying materials are made available under the terms of the eclipse public license v{v}", "licensed under the eclipse public license, version {v}")),
    "CCBY{v}": (("3.0", "4.0"), ("licensed under cc by {v}", "this work is licensed under cc by {v}", "this work is licensed under a creative commons attribution {v} international license")),
    "CCBYSA{v}": (("3.0", "4.0"), ("licensed under cc by-sa {v}", "this work is licensed under cc by-sa {v}", "this work is licensed under a creative commons attribution-sharealike {v} international license")),
    "CCBYNC{v}": (("3.0", "4.0"), ("licensed under cc by-nc {v}", "this work is licensed under cc by-nc {v}", "this work is licensed under a creative commons attribution-noncommercial {v} international license")),
    "CCBYNCSA{v}": (("3.0", "4.0"), ("licensed under cc by-nc-sa {v}", "this work is licensed under cc by-nc-sa {v}")),
    "CCBYND{v}": (("3.0", "4.0"), ("licensed under cc by-nd {v}", "this work is licensed under cc by-nd {v}")),
}
_PLAIN = {
    "MITname": ("released under the mit license", "licensed under the mit license", "this work is licensed under the mit license"),
    "BSD3name": ("licensed under the bsd 3-clause license", "released under the bsd 3-clause license"),
    "BSD2name": ("licensed under the bsd 2-clause license", "released under the bsd 2-clause license"),
    "CC0name": ("licensed under cc0 1.0", "this work is released into the public domain under cc0 1.0"),
    "MITgrant": ("permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"software\"), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions",),
    "MITnotice": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",),
    "ASIS": ("the software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement",),
    "MITliable": ("in no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software",),
    "ISCgrant": ("permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    "ISCdisclaim": ("the software is provided \"as is\" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", "the software is provided \"as is\" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. in no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software"),
    "BSDpre": ("redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",),
    "BSDsource": ("redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",),
    "BSDbinary": ("redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",),
    "BSDendorse": ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission, as far as this license goes", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    "BSDdisclaim": ("this software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed",),
    "BSDliable": tuple(f"in no event shall the copyright {who} or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage" for who in ("holder", "owner", "holders")),
    "ApacheNot": ("you may not use this file except in compliance with the license",),
    "ApacheCopy": tuple(f"you may obtain a copy of the license at{gap} http{s}://www.apache.org/licenses/license-2.0" for gap in ("", ".") for s in ("", "s")),
    "ApacheSee": ("see the license for the specific language governing permissions and limitations under the license",),
    "NOWARRANTY": (*[t.format(work=w) for w in ("program", "library") for t in (_HOPE, _EVEN)], "unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an \"as is\" basis, without warranties or conditions of any kind, either express or implied"),
    "SEEGNU": tuple(f"see the gnu {name} for more details" for name in _FAMILY.values()),
    "UNLICENSE": ("this is free and unencumbered software released into the public domain",),
    "SEECOPY": tuple(_RECEIVED.format(work=w, name=n) + more for w in ("program", "library") for n in _FAMILY.values() for more in ("", ". if not, see <http://www.gnu.org/licenses/>", ". if not, see <https://www.gnu.org/licenses/>", "; if not, see <http://www.gnu.org/licenses/>", "; if not, see <https://www.gnu.org/licenses/>", "; if not, write to the free software foundation, inc., 51 franklin street, fifth floor, boston, ma 02110-1301 usa")),
    "ALLRIGHTS": ("copyright all rights reserved",),
}
# Rules in the order in which they apply: identifiers in a row -> license. {v} as above.
_RULES = [
    (("BSDpre", "BSDsource", "BSDbinary", "BSDendorse", "BSDdisclaim", "BSDliable"), "BSD-3-Clause"),
    (("BSDpre", "BSDsource", "BSDbinary", "BSDendorse"), "BSD-3-Clause"),
    (("BSDpre", "BSDsource", "BSDbinary", "BSDdisclaim", "BSDliable"), "BSD-2-Clause"),
    (("BSDpre", "BSDsource", "BSDbinary"), "BSD-2-Clause"),
    (("MITgrant", "MITnotice", "ASIS", "MITliable"), "MIT"),
    (("MITgrant", "MITnotice", "ASIS"), "MIT"),
    (("MITgrant", "MITnotice"), "MIT"),
    (("Apache2.0", "ApacheNot", "ApacheCopy", "NOWARRANTY", "ApacheSee"), "Apache-2.0"),
    (("Apache2.0", "ApacheNot", "ApacheCopy"), "Apache-2.0"),
    (("Apache2.0", "ApacheNot"), "Apache-2.0"),
    *[((f"{f}{{v}}{ref}", *rest), f"{name}-{how}") for f, name in (("GPL", "GPL-{v}.0"), ("LGPL", "LGPL-{v}"), ("AGPL", "AGPL-{v}.0")) for ref, how in (("ref", "or-later"),) for rest in (("NOWARRANTY", "SEEGNU", "SEECOPY"), ("NOWARRANTY", "SEEGNU"), ("NOWARRANTY",), ())],
    *[((f"{f}{{v}}", *rest), name) for f, name in (("GPL", "GPL-{v}.0-only"), ("LGPL", "LGPL-{v}"), ("AGPL", "AGPL-{v}.0")) for rest in (("NOWARRANTY", "SEEGNU", "SEECOPY"), ("NOWARRANTY",), ())],
    (("Apache{v}",), "Apache-{v}"),
    (("MPL{v}",), "MPL-{v}"),
    (("EPL{v}",), "EPL-{v}"),
    (("CCBYNCSA{v}",), "CC-BY-NC-SA-{v}"),
    (("CCBYNC{v}",), "CC-BY-NC-{v}"),
    (("CCBYSA{v}",), "CC-BY-SA-{v}"),
    (("CCBYND{v}",), "CC-BY-ND-{v}"),
    (("CCBY{v}",), "CC-BY-{v}"),
    (("ISCgrant", "ISCdisclaim"), "ISC"),
    (("ISCgrant", "ASIS"), "ISC"),
    (("ISCgrant",), "ISC"),
    (("MITname",), "MIT"),
    (("BSD3name",), "BSD-3-Clause"),
    (("BSD2name",), "BSD-2-Clause"),
    (("CC0name",), "CC0-1.0"),
    (("UNLICENSE",), "Unlicense"),
]


def normalised(sentence: str) -> str:
    """What the SQL below makes of a sentence."""
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in sentence.lower()).split())


def _texts() -> list[tuple[str, str]]:
    """(sentence, identifier)"""
    found = [(s, name) for name, texts in _PLAIN.items() for s in texts]
    return found + [(s.replace("{v}", str(v)), name.replace("{v}", str(v))) for name, (versions, texts) in _VERSIONED.items() for v in versions for s in texts]


def known_sentences() -> dict[str, str]:
    """Normalised sentence -> identifier."""
    return {normalised(s): name for s, name in _texts()}


def rules() -> list[tuple[str, str]]:
    """(identifiers in a row, as ',a,b,', license), in order."""
    out = []
    for names, license_id in _RULES:
        versions = next((_VERSIONED[n][0] for n in names if "{v}" in n), ("",))
        out += [(",".join(["", *names, ""]).replace("{v}", str(v)), license_id.replace("{v}", str(v))) for v in versions]
    return out


def parts(sentence: str) -> tuple[str, ...]:
    """The normalised parts that the cut makes of a sentence: more than one where it has a '.', ':' or ';' inside."""
    return tuple(filter(None, map(normalised, re.split(r"[.!?:;]+[ \t\n]+", sentence))))


def known_parts() -> tuple[dict[str, str], list[tuple[tuple[str, ...], str]]]:
    """(part -> code, [(codes in a row, identifier)], longest first). A sentence of one part has its identifier as code;
    codes of further sentences' parts begin with '+'."""
    codes, rows = {}, []
    for sentence, name in _texts():
        own = parts(sentence)
        if len(own) == 1:
            codes[own[0]] = name
        else:
            rows.append((tuple(codes.setdefault(p, f"+{len(codes)}") for p in own), name))
    return codes, sorted(rows, key=lambda r: -len(r[0]))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _spark_sql(column: str) -> str:
    """Expression of the identifiers of a text's sentences.

    Each border of the cut with joined lines is one of the line-wise cut too, so line-wise parts lie inside joined ones:
    joined line ends become a mark, and a part that isn't known with its lines joined is cut at its marks."""
    codes, rows = known_parts()
    keys = ", ".join(map(_quoted, codes))
    values = ", ".join(map(_quoted, codes.values()))
    bare = f"translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ\\u0001', 'abcdefghijklmnopqrstuvwxyz ')"
    low = f"regexp_replace({bare}, '(?m)^[\\\\x20\\\\t]*(?:/[*]+|[*]+/?|#+|//+|--+|;+|%+)(?=\\\\s|$)', '')"
    joined = f"regexp_replace(regexp_replace({low}, '\\\\n[\\\\x20\\\\t]*\\\\n', '.\\n'), '([^.!?:;])\\\\n', '$1\\u0001')"
    bounded = f"regexp_replace({joined}, '[.!?:;]+[\\\\x20\\\\t\\\\n]+', '\\n')"

    def coded(part: str) -> str:
        return f"element_at(map_from_arrays(array({keys}), array({values})), trim(regexp_replace({part}, '[^a-z0-9]+', ' ')))"

    # an unknown part is a bar, so that only neighbours make a row; one without letters and digits is nothing
    lines = f"transform(filter(split(s, '\\u0001+'), l -> l rlike '[a-z0-9]'), l -> coalesce({coded('l')}, '|'))"
    found = f"transform(split({bounded}, '\\n+'), s -> transform(array({coded('s')}), c -> case when c is null then array_join({lines}, ',,') else c end)[0])"
    row = f"concat(',', array_join(filter({found}, x -> x <> ''), ',,'), ',')"
    for own, name in rows:
        row = f"replace({row}, {_quoted(',' + ',,'.join(own) + ',')}, {_quoted(',' + name + ',')})"
    return f"filter(split({row}, ',+'), x -> x <> '' and x <> '|' and not startswith(x, '+'))"


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences (known license sentences), sentence_ids and licenses (comma-joined, in order of the text and of the
    rules), leftover (known sentences that no rule has used).

    A null or empty text has none. A sentence counts if either way to cut finds it; one with its lines joined counts once,
    whatever its lines hold. Marks that begin comment lines are no part of a text. One row per input row, repeated ones too; other columns are not read."""
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    look = " or ".join(f"contains({low}, '{w}')" for w in TRIGGERS)
    none = "cast(array() as array<string>)"
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    ids = texts.select("doc_id", F.expr(f"case when {look} then {_spark_sql('text')} else {none} end").alias("ids"))
    return ids.select("doc_id", F.expr("cast(size(ids) as long)").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"), _matched().alias("m")).select(
        "doc_id", "n_sentences", "sentence_ids", F.array_join("m.licenses", ",").alias("licenses"), F.expr("trim(both ',' from regexp_replace(m.rest, '[,|]+', ','))").alias("leftover")
    )


def _matched() -> Column:
    """Rules in order, each replacing the identifiers that it matches in the sequence by a bar.

    A comma is doubled between identifiers so that neighbours don't share one."""
    table = ", ".join(f"struct({_quoted(seq.replace(',', ',,').removeprefix(',').removesuffix(','))} as seq, {_quoted(name)} as name)" for seq, name in rules())
    start = "struct(case when size(ids) = 0 then '' else concat(',', array_join(ids, ',,'), ',') end as rest, cast(array() as array<string>) as licenses)"
    step = "(acc, r) -> case when contains(acc.rest, r.seq) then struct(replace(acc.rest, r.seq, '|') as rest, case when array_contains(acc.licenses, r.name) then acc.licenses else concat(acc.licenses, array(r.name)) end as licenses) else acc end"
    return F.expr(f"aggregate(array({table}), {start}, {step})")


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(read(spark, sf_dir, "documents"))


def oracle() -> str:
    known = known_sentences()
    table = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in known.items())
    bar = [(seq.replace(",", ",,").removeprefix(",").removesuffix(","), name) for seq, name in rules()]
    steps = "\n".join(
        f", s{k + 1} as (select doc_id, ids, n, replace(rest, {_quoted(seq)}, '|') rest, case when contains(rest, {_quoted(seq)}) and not list_contains(lic, {_quoted(name)}) then list_append(lic, {_quoted(name)}) else lic end lic from s{k})"
        for k, (seq, name) in enumerate(bar)
    )
    cut = "string_split_regex(regexp_replace({}, '[.!?:;]+[ \\t\\n]+', chr(10), 'g'), '\\n+')"
    joined = r"regexp_replace(regexp_replace(low, '\n[ \t]*\n', '.' || chr(10), 'g'), '([^.!?:;])\n', '\1 ', 'g')"
    return f"""
with known(s, id) as (values {table}),
low as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') low from documents),
cuts as (select doc_id, 1 way, {cut.format('low')} p from low union all select doc_id, 2, {cut.format(joined)} from low),
parts as (select doc_id, way, unnest(range(1, len(p) + 1)) k, p from cuts),
seen as (select doc_id, way, k, id from parts join known on trim(regexp_replace(p[k], '[^a-z0-9]+', ' ', 'g')) = s),
lists as (select doc_id, way, list(id order by k) ids, count(*) n from seen group by 1, 2),
one as (select d.doc_id, coalesce(arg_max(ids, n * 2 - way + 2), []) ids, coalesce(max(n), 0) n from documents d left join lists using (doc_id) group by 1),
s0 as (select doc_id, ids, n, case when n = 0 then '' else ',' || array_to_string(ids, ',,') || ',' end rest, cast([] as varchar[]) lic from one)
{steps}
select doc_id, cast(n as bigint) n_sentences, coalesce(array_to_string(ids, ','), '') sentence_ids, coalesce(array_to_string(lic, ','), '') licenses,
  trim(regexp_replace(rest, '[,|]+', ',', 'g'), ',') leftover
from s{len(bar)}
"""


ORACLE = {"op1_license_scan": oracle()}
