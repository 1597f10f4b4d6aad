"""License scans by ordered signature rules, with DataFrame functions only.

A text becomes lower-case words between single blanks. Rules are regexes over
these words; a rule runs only on texts that hold its keyword. A detection that
lies within a longer one, or in the same place as one of an earlier rule, is
suppressed. Time grows with the words of a text, not with the square of its places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What is no part of a word, and the phrases that are always counted.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Label, a word that the name must hold, and how the name is written over words.
NAMES = (
    ("mit-0", "attribution", "mit no attribution"),
    ("mit", "mit", "mit"),
    ("x11", "x11", "x11"),
    ("isc", "isc", "isc"),
    ("isc", "consortium", "internet systems consortium"),
    ("apache-2.0", "apache", "apache(?: software)?(?: license)?(?: version| v)? 2(?: 0)?"),
    ("apache-1.1", "apache", "apache(?: software)?(?: license)?(?: version| v)? 1 1"),
    ("apache-1.0", "apache", "apache(?: software)?(?: license)?(?: version| v)? 1 0"),
    ("apache", "apache", "apache(?: software)?"),
    ("bsd-2-clause", "bsd", "bsd 2 clause|2 clause bsd|simplified bsd"),
    ("bsd-3-clause", "bsd", "bsd 3 clause|3 clause bsd|new bsd|revised bsd|modified bsd"),
    ("bsd-4-clause", "bsd", "bsd 4 clause|4 clause bsd|original bsd"),
    ("bsd", "bsd", "bsd"),
    ("agpl-3.0", "affero", "(?:gnu )?affero general public(?: license)?(?:(?: version| v)? 3(?: 0)?)?"),
    ("agpl-3.0", "agpl", "(?:gnu )?agpl(?: v? ?3(?: 0)?)?"),
    ("lgpl-2.1", "lesser", "(?:gnu )?lesser general public(?: license)?(?: version| v)? 2 1"),
    ("lgpl-3.0", "lesser", "(?:gnu )?lesser general public(?: license)?(?: version| v)? 3(?: 0)?"),
    ("lgpl", "lesser", "(?:gnu )?lesser general public"),
    ("lgpl", "lgpl", "(?:gnu )?lgpl(?: v? ?[23](?: [01])?)?"),
    ("gpl-2.0", "general", "(?:gnu )?general public(?: license)?(?: version| v)? 2(?: 0)?"),
    ("gpl-3.0", "general", "(?:gnu )?general public(?: license)?(?: version| v)? 3(?: 0)?"),
    ("gpl", "general", "(?:gnu )?general public"),
    ("gpl", "gpl", "(?:gnu )?gpl(?: v? ?[23](?: 0)?)?"),
    ("mpl-2.0", "mozilla", "mozilla public(?: license)?(?: version| v)? 2(?: 0)?"),
    ("mpl-2.0", "mpl", "mpl 2(?: 0)?"),
    ("mpl-1.1", "mozilla", "mozilla public(?: license)?(?: version| v)? 1 1"),
    ("epl-2.0", "eclipse", "eclipse public(?: license)?(?: version| v)? 2(?: 0)?"),
    ("epl-1.0", "eclipse", "eclipse public(?: license)?(?: version| v)? 1(?: 0)?"),
    ("cddl-1.0", "cddl", "cddl(?: 1 [01])?"),
    ("cddl-1.0", "distribution", "common development and distribution"),
    ("cc0-1.0", "cc0", "cc0(?: 1 0)?"),
    ("cc0-1.0", "zero", "creative commons zero"),
    ("cc-by-nc-nd", "nd", "(?:cc|creative commons) by nc nd(?: [1-4] 0)?"),
    ("cc-by-nc-sa", "nc", "(?:cc|creative commons) by nc sa(?: [1-4] 0)?"),
    ("cc-by-nc", "nc", "(?:cc|creative commons) by nc(?: [1-4] 0)?"),
    ("cc-by-nd", "nd", "(?:cc|creative commons) by nd(?: [1-4] 0)?"),
    ("cc-by-sa", "sa", "(?:cc|creative commons) by sa(?: [1-4] 0)?"),
    ("cc-by", "by", "(?:cc|creative commons) by(?: [1-4] 0)?"),
    ("unlicense", "unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("zlib", "zlib", "zlib(?: libpng)?"),
    ("bsl-1.0", "boost", "boost(?: software)?"),
    ("artistic-2.0", "artistic", "artistic(?: license)? 2(?: 0)?"),
    ("eupl", "eupl", "eupl(?: 1 [12])?"),
    ("eupl", "european", "european union public"),
    ("ofl-1.1", "font", "(?:sil )?open font"),
    ("python-2.0", "python", "python software foundation"),
    ("proprietary", "proprietary", "proprietary"),
)

# How a license is named in a sentence, in order of trust, and the score of each way.
WAYS = (
    ("spdx license identifier (?:{0})", 1.0),
    ("licensed (?:to you )?(?:under|with) (?:the )?(?:terms of (?:the )?)?(?:{0})(?: licen[cs]e)?", 0.95),
    ("(?:released|published|available|provided|free) under (?:the )?(?:terms of (?:the )?)?(?:{0})(?: licen[cs]e)?", 0.9),
    ("(?:distributed|redistributed|used) (?:under|subject to) (?:the )?(?:terms of (?:the )?)?(?:{0})(?: licen[cs]e)?", 0.9),
    ("(?:governed|covered) by (?:the )?(?:{0})(?: licen[cs]e)?", 0.85),
    ("licen[cs]e (?:is )?(?:the )?(?:{0})", 0.8),
    ("(?:{0}) licen[cs]ed?", 0.7),
)
BASE_SCORE = 0.6

# Names that join a license and its version in one word: label, how the word begins, the words. They need no sentence around them.
JOINED = (
    ("agpl-3.0", "agplv", "agplv3(?: 0)?(?: only| or later)?"),
    ("agpl-3.0", "agpl3", "agpl3(?: 0)?"),
    ("lgpl-2.0", "lgplv", "lgplv2(?: 0)?"),
    ("lgpl-2.1", "lgplv", "lgplv2 1(?: only| or later)?"),
    ("lgpl-3.0", "lgplv", "lgplv3(?: 0)?(?: only| or later)?"),
    ("lgpl-2.1", "lgpl2", "lgpl2 1|lgpl21"),
    ("lgpl-3.0", "lgpl3", "lgpl3(?: 0)?"),
    ("gpl-1.0", "gplv", "gplv1(?: 0)?"),
    ("gpl-2.0", "gplv", "gplv2(?: 0)?(?: only| or later)?"),
    ("gpl-3.0", "gplv", "gplv3(?: 0)?(?: only| or later)?"),
    ("gpl-2.0", "gpl2", "gpl2(?: 0)?"),
    ("gpl-3.0", "gpl3", "gpl3(?: 0)?"),
    ("apache-2.0", "apache2", "apache2(?: 0)?"),
    ("apache-2.0", "apachev", "apachev2(?: 0)?"),
    ("apache-2.0", "asl2", "asl2(?: 0)?"),
    ("mpl-2.0", "mplv", "mplv2(?: 0)?"),
    ("mpl-1.1", "mplv", "mplv1 1"),
    ("mpl-2.0", "mpl2", "mpl2(?: 0)?"),
    ("epl-1.0", "eplv", "eplv1(?: 0)?"),
    ("epl-2.0", "eplv", "eplv2(?: 0)?"),
    ("eupl-1.2", "euplv", "euplv1 2"),
    ("bsd-2-clause", "bsd2", "bsd2(?: clause)?"),
    ("bsd-3-clause", "bsd3", "bsd3(?: clause)?"),
    ("bsl-1.0", "bslv", "bslv1(?: 0)?"),
    ("cc-by", "ccby", "ccby(?: ?[1-4] 0)?"),
    ("cc-by-sa", "ccbysa", "ccbysa(?: ?[1-4] 0)?"),
)
JOINED_SCORE = 0.75

# Sentences of the licenses themselves, which seldom name them: label, a word of the sentence, the sentence, its score.
BODIES = (
    ("mit", "sublicense", "use copy modify merge publish distribute sublicense and or sell copies of the software", 1.0),
    ("mit", "hereby", "permission is hereby granted free of charge to any person obtaining a copy of this software", 1.0),
    ("mit", "hereby", "permission is hereby granted free of charge", 0.8),
    ("mit", "noninfringement", "warranties of merchantability fitness for a particular purpose and noninfringement", 0.7),
    ("mit", "portions", "included in all copies or substantial portions of the software", 0.9),
    ("isc", "hereby", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 1.0),
    ("isc", "author", "the software is provided as is and the author disclaims all warranties", 0.9),
    ("bsd", "redistribution", "redistribution and use in source and binary forms(?: with or without modification)?(?: are permitted)?", 0.95),
    ("bsd", "retain", "redistributions of source code must retain the above copyright notice", 0.95),
    ("bsd", "reproduce", "redistributions in binary form must reproduce the above copyright notice", 0.95),
    ("bsd-3-clause", "endorse", "may be used to endorse or promote products derived from this software", 0.95),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display", 1.0),
    ("apache-2.0", "perpetual", "a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license", 0.95),
    ("apache-2.0", "compliance", "you may not use this file except in compliance with the license", 0.9),
    ("apache-2.0", "conditions", "without warranties or conditions of any kind either express or implied", 0.85),
    ("apache-2.0", "writing", "unless required by applicable law or agreed to in writing", 0.7),
    ("gpl", "redistribute", "this program is free software you can redistribute it and or modify it", 0.95),
    ("gpl", "hope", "this program is distributed in the hope that it will be useful", 0.9),
    ("gpl", "received", "you should have received a copy of the gnu general public license", 0.95),
    ("gpl", "verbatim", "everyone is permitted to copy and distribute verbatim copies of this license document", 0.9),
    ("gpl-3.0", "copyleft", "a free copyleft license for software and other kinds of works", 1.0),
    ("lgpl", "library", "this library is free software you can redistribute it and or modify it", 0.95),
    ("lgpl", "received", "you should have received a copy of the gnu lesser general public license", 0.95),
    ("agpl-3.0", "received", "you should have received a copy of the gnu affero general public license", 0.95),
    ("agpl-3.0", "remotely", "users interacting with it remotely through a computer network", 0.95),
    ("mpl-2.0", "mozilla", "this source code form is subject to the terms of the mozilla public license", 1.0),
    ("mpl-2.0", "incompatible", "incompatible with secondary licenses as defined by the mozilla public license", 1.0),
    ("epl-2.0", "accompanying", "this program and the accompanying materials are made available under the terms of the eclipse public license", 1.0),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented", 1.0),
    ("zlib", "altered", "altered source versions must be plainly marked as such", 1.0),
    ("bsl-1.0", "executable", "solely in the form of machine executable object code generated by a source language processor", 1.0),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain", 1.0),
    ("unlicense", "unencumbered", "free and unencumbered software", 0.95),
    ("public-domain", "domain", "(?:dedicated|released|placed) (?:to|into|in) the public domain", 0.8),
    ("cc0-1.0", "waived", "waived all copyright and related or neighboring rights", 1.0),
    ("wtfpl", "fuck", "do what the fuck you want to(?: public license)?", 1.0),
    ("artistic-2.0", "permitted", "you are permitted to use the standard version and create and use modified versions for any purpose", 0.95),
    ("ofl-1.1", "font", "neither the font software nor any of its individual components in original or modified versions may be sold by itself", 1.0),
    ("proprietary", "confidential", "(?:confidential and proprietary|proprietary and confidential)", 0.8),
    ("proprietary", "unauthorized", "unauthorized (?:copying|use|reproduction|distribution) of this (?:file|software|document)", 0.85),
    ("proprietary", "reserved", "all rights reserved no part of this", 0.8),
)
# What stands around a match while places are read; no part of any word.
_OPEN, _SHUT = "\x01", "\x02"


def rules() -> list[tuple[str, str, str, float]]:
    """(label, keyword, regex, score) in order of priority: sentences of licenses, ways to name one by trust, joined names."""
    named = [(label, f" {word} ", way.format(name), score) for way, score in WAYS for label, word, name in NAMES]
    bodies = [(label, f" {word} ", sentence, score) for label, word, sentence, score in BODIES]
    return bodies + named + [(label, f" {word}", name, JOINED_SCORE) for label, word, name in JOINED]


def words_between_blanks(text: Column) -> Column:
    """The text's words, each with one blank before it, and a blank at the end; one blank if none."""
    # lower() also changes other letters, but no letter of another script becomes one of a phrase or rule's, nor any a gap
    spaced = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), NO_WORD, " "))
    return F.when(spaced == "", " ").otherwise(F.concat(F.lit(" "), spaced, F.lit(" ")))


def _blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once; it gives an array."""
    return F.flatten(F.transform(F.array(value), body))


def _places(words: Column, regex: Column) -> Column:
    """Start and end (words from 0, end exclusive) of each match; the regex begins and ends at a word's edge.

    Matches are marked in the text, and the marked words' numbers are read off it: one pass, however many matches.
    """
    whole = F.concat(F.lit("(?<= )(?:"), regex, F.lit(")(?= )"))
    numbered = lambda own, marked, less: F.filter(
        F.transform(own, lambda w, i: F.when(marked(w), i - less)), lambda i: i.isNotNull()
    )
    pairs = lambda own: F.zip_with(
        numbered(own, lambda w: F.startswith(w, F.lit(_OPEN)), 1),
        numbered(own, lambda w: F.endswith(w, F.lit(_SHUT)), 0),
        lambda a, b: F.struct(a.alias("start"), b.alias("stop")),
    )
    none = F.array().cast("array<struct<start:int,stop:int>>")
    return _bound(
        F.regexp_replace(words, whole, F.lit(f"{_OPEN}$0{_SHUT}")),
        lambda m: F.when(F.contains(m, F.lit(_OPEN)), _bound(F.split(m, " "), pairs)).otherwise(none),
    )


def _greatest_so_far(values: Column) -> Column:
    """Running maximum of an array of integers, in steps that each look twice as far back."""
    steps = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(2)))).cast("int")), lambda k: F.pow(F.lit(2), k).cast("int"))
    return F.aggregate(steps, values, lambda own, back: F.transform(own, lambda v, i: F.greatest(v, F.get(own, i - back))))


def _rule_groups(named: bool) -> Column:
    """The rules as a literal, grouped by keyword; with or without those that look for a name in a sentence."""
    groups: dict[str, list[Column]] = {}
    for priority, (label, keyword, regex, score) in enumerate(rules()):
        if not named and len(BODIES) <= priority < len(BODIES) + len(WAYS) * len(NAMES):
            continue
        rule = F.struct(
            F.lit(priority).alias("priority"), F.lit(label).alias("label"), F.lit(regex).alias("regex"), F.lit(score).alias("score")
        )
        groups.setdefault(keyword, []).append(rule)
    return F.array(*[F.struct(F.lit(k).alias("keyword"), F.array(*r).alias("rules")) for k, r in groups.items()])


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with words, base places and detections, row by row, without a shuffle.

    Columns: doc_id, n_words, base (array of label and starts), detections (array of
    start, stop, priority, label, score; what is suppressed is gone). A null or empty
    text has no words and no places; repeated rows and null ids stay; further columns
    are not read.
    """
    hit = lambda words, keyword: F.contains(words, keyword)
    rows = docs.select("doc_id", words_between_blanks(F.col("text").cast("string")).alias("words"))
    words = F.col("words")
    base = F.array(
        *[
            F.struct(
                F.lit(label).alias("label"),
                F.when(
                    hit(words, F.lit(f" {phrase} ")), F.transform(_places(words, F.lit(phrase)), lambda p: p["start"])
                ).otherwise(F.array().cast("array<int>")).alias("starts"),
            )
            for phrase, label in BASE
        ]
    )
    # every way to name a license has one of these
    licensed = F.lit(False)
    for sign in ("licen", " under ", " subject to ", "governed by", "covered by"):
        licensed = licensed | hit(words, F.lit(sign))
    groups = F.when(licensed, _rule_groups(True)).otherwise(_rule_groups(False))
    gated = F.filter(groups, lambda g: hit(words, g["keyword"]))
    found = F.flatten(
        F.transform(
            F.flatten(F.transform(gated, lambda g: g["rules"])),
            lambda r: F.transform(
                _places(words, r["regex"]),
                lambda p: F.struct(
                    p["start"].alias("start"), (-p["stop"]).alias("back"), r["priority"].alias("priority"),
                    r["label"].alias("label"), r["score"].alias("score"),
                ),
            ),
        )
    )
    rows = rows.select(
        "doc_id",
        (F.greatest(_blanks(words), F.lit(1)) - 1).cast("long").alias("n_words"),
        base.alias("base"),
        F.sort_array(found).alias("found"),
    )
    # sorted by start, the longer and the earlier rule first: what ends no later than one before it lies within that one
    upto = _greatest_so_far(F.transform("found", lambda d: -d["back"]))
    before = F.slice(F.concat(F.array(F.lit(0)), upto), F.lit(1), F.size("found"))
    kept = F.zip_with(
        "found", before,
        lambda d, most: F.when(
            -d["back"] > most,
            F.struct(
                d["start"].alias("start"), (-d["back"]).alias("stop"), d["priority"].alias("priority"),
                d["label"].alias("label"), d["score"].alias("score"),
            ),
        ),
    )
    kept = F.filter(kept, lambda d: d.isNotNull())
    return rows.select("doc_id", "n_words", "base", kept.alias("detections"))


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns, from what ``scan`` returns."""
    starts = F.flatten(F.transform("base", lambda b: b["starts"]))
    base = F.transform(F.filter("base", lambda b: F.size(b["starts"]) > 0), lambda b: b["label"])
    own = F.transform("detections", lambda d: d["label"])
    rows = scanned.select("doc_id", "n_words", starts.alias("starts"), base.alias("base"), own.alias("own"), "detections")
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    score = F.greatest(
        F.coalesce(F.array_max(F.transform("detections", lambda d: d["score"])), F.lit(0.0)),
        F.when(F.size("starts") > 0, F.lit(BASE_SCORE)).otherwise(0.0),
    )
    return rows.select(
        "doc_id",
        "n_words",
        F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").cast("long").alias("first_word"),
        F.array_max("starts").cast("long").alias("last_word"),
        joined(F.col("base")).alias("base_labels"),
        joined(F.concat("base", "own")).alias("labels"),
        score.alias("score"),
    )
