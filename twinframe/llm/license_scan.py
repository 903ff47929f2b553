"""License texts inside documents: MinHash bands over overlapping windows find templates, exact shingles verify them.

See ``windows`` for the method and for nulls, short texts and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinframe.llm.windows import THRESHOLD, found_items, search_sql

# License identifiers with notices. A version or variant stands in so many of a template's shingles that no
# other one's text reaches the threshold.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
        'on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    ("GPL-3.0", "GNU General Public License, version 3."),
    ("GPL-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    (
        "LGPL-2.1",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either "
        "version 2.1 of the License",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-2.0", "GNU General Public License, version 2."),
    ("AGPL-3.0", "GNU Affero General Public License, version 3."),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3."),
    ("LGPL-2.1", "GNU Lesser General Public License, version 2.1."),
    ("EPL-2.0", "Eclipse Public License, version 2.0."),
    ("CC-BY-4.0", "under CC BY 4.0."),
    ("CC-BY-SA-4.0", "under CC BY-SA 4.0."),
    ("CC-BY-ND-4.0", "under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "under CC BY-NC-ND 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
]


def licenses(
    docs: DataFrame,
    templates: list[tuple[str, str]] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``id_col``, ``license``, ``template`` (its number), ``containment`` and ``first_word`` of every template found."""
    listed = [(i, name, text) for i, (name, text) in enumerate(TEMPLATES if templates is None else templates)]
    table = docs.sparkSession.createDataFrame(listed, "template int, license string, text string")
    found = found_items(docs, table, id_col, text_col, "template", "text", threshold)
    named = found.withColumnRenamed("item", "template").join(F.broadcast(table.drop("text")), "template")
    return named.select(F.col("id").alias(id_col), "license", "template", "containment", "first_word")


def oracle_sql() -> str:
    quoted = [(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(TEMPLATES)]
    values = ", ".join(f"({i}, '{name}', '{text}')" for i, name, text in quoted)
    found = search_sql(f"SELECT item, t FROM (VALUES {values}) AS v(item, license, t)")
    return (
        f"SELECT id AS doc_id, license, CAST(item AS INTEGER) AS template, containment, first_word FROM ({found}) "
        f"JOIN (SELECT item, license FROM (VALUES {values}) AS v(item, license, t)) USING (item)"
    )
