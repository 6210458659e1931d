from itertools import permutations

from loomspan.plans import facts


def edits(x, y):
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return row[-1]


def test_all_people_of_facts_are_compared(spark, tmp_path):
    # subject by id, object by id, spelled name with blanks, one that no fact names, one of another type
    people = {"ada_lee": "Ada Lee", "ada_leo": "Ada Leo", "max_o_hara": "Max O'Hara", "max_ohara": "Max Ohara", "tom_fay": "Tom Fay", "tom_ray": "Tom Ray"}
    triples = [("1", "ada_lee", "uses", "ada_leo"), ("2", "Tom Fay", "leads", "max_ohara"), ("3", None, "leads", None)]
    entities = [(i, n, "person") for i, n in people.items()] + [("ada_let", "Ada Let", "project")]
    spark.createDataFrame(entities, "id string, name string, type string").selectExpr("*", "cast(null as string) properties", "timestamp'2025-01-01' created_at").write.parquet(f"{tmp_path}/entities.parquet")
    t = spark.createDataFrame(triples, "id string, subject string, predicate string, object string")
    t.selectExpr("*", *[f"cast(null as string) {c}" for c in ("valid_from", "valid_to", "source_closet", "source_file", "adapter_name", "source_drawer_id")], "cast(null as double) confidence", "timestamp'2025-01-01' extracted_at").write.parquet(f"{tmp_path}/triples.parquet")
    # the key of Max O'Hara's name is max_ohara too
    named = {"Ada Lee", "Ada Leo", "Tom Fay", "Max Ohara", "Max O'Hara"}
    expected = {(a, b, edits(a.lower(), b.lower())) for a, b in permutations(people.values(), 2) if a in named and 1 <= edits(a.lower(), b.lower()) <= 2}
    assert set(map(tuple, facts.similar_names(spark, str(tmp_path)).collect())) == expected and len(expected) == 5
