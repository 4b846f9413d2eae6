from strandline.llm import licenses as L
from strandline.llm import queries


def test_places_labels(spark):
    rows = [
        (1, "Released under the MIT License."),
        (2, "mit\nlicense and APACHE - License; general public license"),
        (3, "summit license, mit licenses"),
        (4, "Redistribution and use in source and binary forms, with or without modification, are allowed provided that the following conditions are met:"),
        (5, None),
        (6, ""),
        (7, "All rights\treserved"),
    ]
    got = {r.doc_id: r for r in L.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1].places == [3] and got[1].labels == ["mit"] and got[1].n_words == 5
    assert got[2].places == [0, 3, 5] and got[2].base_labels == ["apache", "gpl", "mit"]
    assert got[3].places == [] and got[3].labels == [] and got[3].score == 0
    assert got[4].labels == ["bsd"] and 0.8 <= got[4].score < 1
    assert got[5].n_words == got[6].n_words == 0
    assert got[7].labels == ["all-rights-reserved"]


def test_against_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    want = con.execute(L.scan_sql())
    names = [c[0] for c in want.description]
    got = queries.op4_licenses(spark, sf)
    assert sorted(map(str, map(tuple, got.select(names).collect()))) == sorted(map(str, want.fetchall()))


def test_odd_rows(spark, odd, none):
    got = L.scan(odd).collect()
    assert len(got) == odd.count() and L.scan(none).count() == 0
    assert max(r.n_words for r in got) == 5000


def test_wrapped_texts(spark):
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"
    mit = "/*\n * Permission is hereby granted, free of charge, to any person\n * obtaining a copy of this software and associated\n * documentation files (the Software), to deal\n */"
    mpl = "# This Source Code Form is subject to the terms of the Mozilla\n# Public License, v. 2.0. If a copy"
    lgpl = "dnl This library is free software; you can redistribute it\ndnl and/or modify it under the terms of the GNU Lesser\ndnl General Public License"
    far = bsd.replace("\n", "\n" + "filler " * 12 + "\n")
    rows = [(1, "x\n" + bsd), (2, mit), (3, mpl), (4, lgpl), (5, far), (6, "all of it\nis right and reserved"), (7, "ALL RIGHTS\nRESERVED"), (1, "x\n" + bsd), (None, bsd)]
    got = [(r.doc_id, r.labels, r.score) for r in L.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    by = {d: labels for d, labels, _ in got}
    assert by == {1: ["bsd"], 2: ["mit"], 3: ["mpl"], 4: ["gpl", "lgpl"], 5: [], 6: [], 7: ["all-rights-reserved"], None: ["bsd"]}
    assert [s for d, _, s in got if d in (1, None)] == [1.0] * 3
