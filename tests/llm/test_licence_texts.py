"""Unedited texts of public licences, wrapped, in comments and on one line."""

import re
import textwrap

import pytest

from tableseek.llm import licences

TEXTS = {
    "mit": """MIT License

Copyright (c) 2024 A. Holder

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "gpl-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY.""",
    "gpl-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "zlib": """Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software.""",
    "apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0',
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "proprietary": "Copyright 2024 A. Holder. All rights reserved.",
}


def forms(text):
    wrapped = "\n\n".join(textwrap.fill(p, 40) for p in text.split("\n\n"))
    yield text
    yield wrapped
    yield wrapped.replace("\n", "\r\n")
    yield re.sub(r"\s+", " ", text)
    for mark in ("# ", "// ", " * ", "REM ", "-- ", ";; "):
        yield "".join(f"{mark}{line}\n" for line in wrapped.split("\n"))
    yield f"/*\n{wrapped}\n*/\nint main() {{}}"


@pytest.mark.parametrize("licence", TEXTS)
def test_unedited_texts_are_found(spark, licence):
    docs = spark.createDataFrame(list(enumerate(forms(TEXTS[licence]))), "doc_id long, text string")
    got = {r.doc_id: r.licences for r in licences.scan_licences(docs, ["doc_id"]).collect()}
    assert set(got.values()) == {licence}, got


def test_other_texts_are_not_found(spark):
    texts = ["Permission is hereby granted to enter the domain.", "He has licensed\nthe song and all rights reserved\nfor him were sold", "Redistribution and use in source form is permitted.", "This is not licensed under the\nMIT License."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.licences for r in licences.scan_licences(docs, ["doc_id"]).orderBy("doc_id").collect()] == ["", "", "", ""]


def test_every_wording_and_rule_has_a_sign():
    single = [licences.SENTENCES[way[0]] for ways in licences.RULES.values() for way in ways if len(way) == 1]
    for known in [*single, *(x for ways in licences.WORDINGS.values() for x in ways)]:
        assert any(sign in known for sign in licences.SIGNS), known
