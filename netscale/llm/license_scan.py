"""License scans by diagonal voting: word k-grams of all texts join those of license templates, and hits vote for offset diagonals.

Each diagonal that has votes is the middle of a span: it is merged with its neighbours, so that words that are put in or left out don't part a
template, and of each place of the template the hit nearest to the middle counts; so repeats of a few words around a template take nothing
from it. A span that has enough votes is verified: of all its words, from its first to its last, and of the template's there, most must agree.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netscale.llm.common import text_of, written

#: Phrases whose every place counts, and well-known sentences of licenses; each with its label.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
TEMPLATES = [
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "apache"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "mit"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit"),
    ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", "mit"),
    ("released under the mit license", "mit"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", "gpl"),
    ("you should have received a copy of the gnu general public license along with this program", "gpl"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "bsd"),
    ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("this work is licensed under a creative commons attribution", "cc"),
    ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "cc0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", "zlib"),
    ("all rights reserved", "proprietary"),
    # whole texts
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software", "isc"),
    ("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required 2 altered source versions must be plainly marked as such and must not be misrepresented as being the original software 3 this notice may not be removed or altered from any source distribution", "zlib"),
    ("this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain", "unlicense"),
    ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following", "boost"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", "gpl"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version", "lgpl"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0", "mpl"),
]
#: Words that alone make no k-gram worth looking up, words of a k-gram, and how far diagonals of one span are from its middle.
COMMON, K, WIDE = frozenset("a and any are by for in is it of on or that the this to under with you".split()), 2, 8
#: The share of a template's k-grams that a span must hold, and of the words there, on either side, that must agree.
SHARE, ALIKE = 0.7, 0.75

_BREAK = r"[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def templates(spark: SparkSession) -> DataFrame:
    """(gram, template, label, base, place, full): each k-gram of each template, and how many the template has. A fixed, small table."""
    rows = []
    for i, (text, label) in enumerate(PHRASES + TEMPLATES):
        words, base = text.split(), i < len(PHRASES)
        grams = [(p, words[p : p + K]) for p in range(len(words) - K + 1)]
        grams = [(p, " ".join(g)) for p, g in grams if base or not COMMON.issuperset(g)]
        rows += [(g, i, label, base, p, len(grams)) for p, g in grams]
    return spark.createDataFrame(rows, "gram string, template int, label string, base boolean, place int, full int")


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of each row of docs.

    A-Z are lower-cased and words are runs of 0-9, a-z and all that isn't ASCII. n_base counts the places of PHRASES, first_word and
    last_word are the smallest and largest word they start at (null without any). A template, of any length, is found where a diagonal and its
    neighbours, at most WIDE away, hold SHARE of its k-grams, and ALIKE of the words from the first to the last of them agree; of a k-gram that is
    there more than once the place nearest to the middle diagonal counts (then the smaller one). labels has those and the phrases'. score
    is the largest share of any span, 1.0 for a phrase, 0.0 for nothing. A null text has no words. Rows that repeat get a row each with the
    same answer; null ids stay. Other columns aren't read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    split = plain.select("doc_id", F.xxhash64("text").alias("th"), F.expr(f"filter(split(text, '{_BREAK}'), w -> w != '')").alias("words"))
    grams = split.select("doc_id", "th", F.expr("posexplode(transform(words, (w, i) -> concat(w, ' ', get(words, i + 1))))").alias("at", "found"))
    known = F.broadcast(templates(spark).withColumn("h", F.xxhash64("gram")))
    lowered = F.translate("found", string.ascii_uppercase, string.ascii_lowercase)
    same = F.startswith(F.col("gram"), lowered) & F.startswith(lowered, F.col("gram"))  # no equality, so as not to become a join key for all rows
    hits = grams.withColumn("h", F.xxhash64(F.lower("found"))).join(known, "h").where(same)
    # a diagonal has as many places as its template has k-grams at most; repeated rows don't add up
    lines = hits.groupBy("doc_id", "th", "template", "label", "base", "full", (F.col("at") - F.col("place")).alias("diagonal")).agg(F.collect_set("place").alias("places"))
    lines = written(lines, "lines")  # few rows, read twice
    base = lines.where("base and size(places) = full")
    near = Window.partitionBy("doc_id", "th", "template").orderBy("diagonal").rangeBetween(-WIDE, WIDE)
    rest = lines.where("not base").withColumn("near", F.collect_list(F.struct("diagonal", "places")).over(near))  # 2 * WIDE + 1 diagonals
    rest = rest.withColumn("hits", F.expr("flatten(transform(near, x -> transform(x.places, p -> named_struct('place', p, 'far', abs(x.diagonal - diagonal), 'diagonal', x.diagonal))))"))
    # of each place the hit nearest to the middle: the first one of its place in this order
    rest = rest.withColumn("hits", F.array_sort("hits")).withColumn("hits", F.expr("filter(hits, (x, i) -> i = 0 or hits[i - 1].place != x.place)"))
    rest = rest.withColumn("share", F.size("hits") / F.col("full"))
    # words of the span, and of the template there, that agree
    rest = rest.withColumn("here", F.expr(f"array_distinct(flatten(transform(hits, x -> sequence(x.diagonal + x.place, x.diagonal + x.place + {K - 1}))))"))
    rest = rest.withColumn("there", F.expr(f"array_distinct(flatten(transform(hits, x -> sequence(x.place, x.place + {K - 1}))))"))
    length = lambda x: f"(array_max({x}) - array_min({x}) + 1)"
    rest = rest.withColumn("alike", F.expr(f"least(size(here), size(there)) / greatest({length('here')}, {length('there')})"))
    nothing = F.lit(None).cast("int")
    found_ = (F.col("share") >= SHARE) & (F.col("alike") >= ALIKE)
    spans = base.select("doc_id", "th", F.col("diagonal").alias("start"), F.col("label").alias("base_label"), "label", F.lit(1.0).alias("share")).unionByName(
        rest.select("doc_id", "th", nothing.alias("start"), F.lit(None).cast("string").alias("base_label"), F.when(found_, F.col("label")).alias("label"), "share")
    )
    found = spans.groupBy("doc_id", "th").agg(
        F.count("start").alias("n_base"), F.min("start").alias("first_word"), F.max("start").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set("base_label")), ",").alias("base_labels"), F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"), F.max("share").alias("score"),
    )
    n = split.select("doc_id", "th", F.size("words").cast("long").alias("n_words"))
    joined = n.join(found, n["doc_id"].eqNullSafe(found["doc_id"]) & (n["th"] == found["th"]), "left")
    return joined.select(
        n["doc_id"], "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long"), F.col("last_word").cast("long"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
