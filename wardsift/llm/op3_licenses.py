"""License scans: MinHash bands over overlapping text windows retrieve templates (see ``templates``).

Bands of one value: a window that holds 0.8 of a template's shingles has a similarity of at least 0.19 with it,
so at least one of 64 bands agrees with a probability above 0.999998.  Exact shingle containment decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from wardsift.llm.frames import Batches, mapped, record, texts
from wardsift.llm.templates import TemplateIndex, blocks, text_shingles
from wardsift.llm.text_arrays import pieces

#: Notices that the licenses ask for or that are common for them.
NOTICES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def notices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(NOTICES.items()), "license_id string, text string")


def license_matches(
    docs: DataFrame,
    templates: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.8,
    width: int = 5,
) -> DataFrame:
    """(``id_col``, ``license_id``, ``n_template``, ``n_shared``, ``first_word``) per document and template
    (columns ``license_id``, ``text``) whose distinct ``width``-word shingles the document holds to ``threshold``.

    ``first_word`` is the number of the word (from 0) at which the first shared shingle begins.  Whole texts are
    scanned and never shuffled.  Null and empty texts match nothing; null ids and repeated rows are returned
    row by row; an empty table gives an empty result; other columns are ignored.
    """
    kind = docs.select(f"`{id_col}`").schema[0].dataType.simpleString()
    schema = f"id {kind}, license_id string, n_template long, n_shared long, first_word long"
    found = docs.sparkSession.createDataFrame([], schema)
    for block in blocks(notices(docs.sparkSession) if templates is None else templates, "license_id", "text", width):
        found = found.union(_scan(texts(docs, id_col, text_col), block, schema, threshold, width))
    return found.withColumnRenamed("id", id_col)


def _scan(narrow: DataFrame, block, schema: str, threshold: float, width: int) -> DataFrame:
    shared = narrow.sparkSession.sparkContext.broadcast(block)

    def run(batches: Batches) -> Batches:
        index = TemplateIndex(*shared.value)
        for piece in pieces(batches, "text"):
            hashes, offsets = text_shingles(piece.column("text"), width)
            row, template, share = index.find(hashes, offsets, threshold)
            first = [
                int(np.flatnonzero(np.isin(hashes[offsets[r] : offsets[r + 1]], index.sets[t]))[0])
                for r, t in zip(row, template)
            ]
            sizes = [len(index.sets[t]) for t in template]
            yield record(
                {
                    "id": piece.column("id").take(pa.array(row)),
                    "license_id": pa.array([index.ids[t] for t in template], pa.string()),
                    "n_template": pa.array(sizes, pa.int64()),
                    "n_shared": pa.array([round(s * n) for s, n in zip(share, sizes)], pa.int64()),
                    "first_word": pa.array(first, pa.int64()),
                }
            )

    return mapped(narrow, run, schema)
