"""License scans: windows of documents retrieve licence templates by MinHash, containment verifies them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decontaminate import shingle_sql
from .license_texts import WHOLE_TEXTS
from .window_search import THRESHOLD, WindowIndex, search

# Notices and opening passages by which public licences are named and granted.
TEMPLATES: tuple[tuple[int, str, str], ...] = (
    (1, "MIT", "Released under the MIT License."),
    (2, "MIT", "This project is licensed under the MIT License - see the LICENSE file for details."),
    (3, "MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    (4, "Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (5, "Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    (6, "Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    (7, "GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (8, "GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    (9, "GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    (10, "LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    (11, "AGPL-3.0", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    (12, "BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    (13, "BSD", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    (14, "MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    (15, "ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    (16, "CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    (17, "CC-BY-4.0", "Licensed under CC BY 4.0."),
    (18, "CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    (19, "CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    (20, "CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    (21, "CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    (22, "Unlicense", "This is free and unencumbered software released into the public domain."),
    (23, "Proprietary", "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means"),
    *WHOLE_TEXTS,
)

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def split(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased."""
    return text.translate(_TABLE).split()


def scan_licenses(docs: DataFrame, templates=TEMPLATES, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """A row per document row and template of which it holds the share ``threshold`` of distinct 5-word shingles or more.

    Columns: ``doc`` (all columns but the text), ``template_id``, ``license``, ``n_shingles``, ``n_shared``, ``containment``,
    and ``first_word``, ``last_word``: places of the first and last word of shared shingles. Null and empty texts
    match nothing; repeated rows match each; an empty table gives no rows. Templates are a table in this module or a
    caller's list, and travel with the code: their number must be small beside a partition's.
    """
    index = WindowIndex({i: split(t.encode()) for i, _, t in templates}, threshold)
    names = {i: name for i, name, _ in templates}
    rows = search(docs, index, split, text_col).select("doc", F.explode("matches").alias("m"))
    name = F.create_map(*[F.lit(x).cast("bigint") if isinstance(x, int) else F.lit(x) for pair in names.items() for x in pair])[F.col("m.id")] if names else F.lit(None).cast("string")
    return rows.select("doc", F.col("m.id").alias("template_id"), name.alias("license"), F.col("m.n_shingles").alias("n_shingles"), F.col("m.n_shared").alias("n_shared"), (F.col("m.n_shared") / F.col("m.n_shingles")).alias("containment"), F.col("m.first_word").alias("first_word"), F.col("m.last_word").alias("last_word"))


def license_query(spark, sf_dir: str) -> DataFrame:
    """op1: all templates against all ``documents``."""
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select(F.col("doc.doc_id").alias("doc_id"), "template_id", "license", "n_shingles", "n_shared", "containment", "first_word", "last_word")


def _sql() -> str:
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    quote = "''"
    values = ", ".join(f"({i}, '{name}', '{text.replace(chr(39), quote)}')" for i, name, text in TEMPLATES)
    placed = f"""(SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s,
    unnest(range(greatest(len(w) - 4, least(len(w), 1)))) AS p, len(w) AS n FROM (SELECT doc_id, {words} AS w FROM documents))"""
    return f"""
WITH t(template_id, license, text) AS (VALUES {values}), ts AS {shingle_sql("t", "template_id, license", words)}, n AS (SELECT template_id, count(*) AS n_shingles FROM ts GROUP BY template_id), d AS {placed}
SELECT doc_id, template_id::BIGINT AS template_id, license, n_shingles, count(DISTINCT s) AS n_shared, count(DISTINCT s) / n_shingles::DOUBLE AS containment, min(p) AS first_word, least(max(p) + 5, any_value(n)) - 1 AS last_word
FROM d JOIN ts USING (s) JOIN n USING (template_id) GROUP BY doc_id, template_id, license, n_shingles HAVING count(DISTINCT s) >= {THRESHOLD} * n_shingles - 1e-9
"""


SQL = _sql()
