from __future__ import annotations

import datetime as dt

import pytest

from slotledger import fixed_values as fv
from slotledger.functions.identifiers import parse_table_name
from slotledger.operators import governance, recommendations

AS_OF = dt.datetime(2024, 1, 31, tzinfo=dt.timezone.utc)
DAY = dt.timedelta(days=1)


@pytest.mark.parametrize(
    "name, parts",
    [("t", (None, "t")), ("d.t", ("d", "t")), ("my-proj.d.t", ("d", "t"))],
)
def test_parse_table_name(name, parts):
    assert parse_table_name(name) == parts


@pytest.mark.parametrize("name", ["", "a b", "x;y", "t\n", "d.t'"])
def test_bad_table_names_are_refused(name):
    with pytest.raises(ValueError):
        parse_table_name(name)


def test_permissions_filters(frame):
    grant = dict(object_type="TABLE", privilege_type="SELECT", object_schema="d", object_name="t")
    grants = frame(
        "object_privileges",
        [
            {**grant, "grantee": "yes"},
            {**grant, "grantee": "view", "object_type": "VIEW"},
            {**grant, "grantee": "update", "privilege_type": "UPDATE"},
            {**grant, "grantee": "elsewhere", "object_schema": "e"},
            {**grant, "grantee": "other", "object_name": "u"},
        ],
    )

    def who(name):
        return sorted(r.grantee for r in governance.table_permissions(grants, name).collect())

    assert who("t") == ["elsewhere", "yes"]
    assert who("d.t") == who("p.d.t") == ["yes"]
    assert who(None) == ["elsewhere", "other", "yes"]


def test_public_datasets(frame):
    datasets = frame(
        "datasets",
        [
            {"dataset_id": "a", "access_entries": [("allUsers", "READER"), (None, "OWNER")]},
            {"dataset_id": "b", "access_entries": [("projectOwners", "OWNER")]},
            {"dataset_id": "c", "access_entries": [("allAuthenticatedUsers", "READER")]},
            {"dataset_id": "d", "access_entries": None},
        ],
    )
    rows = governance.public_datasets(datasets).collect()
    assert sorted((r.object_name, r.grantee) for r in rows) == [
        ("a", "allUsers"), ("c", "allAuthenticatedUsers"),
    ]


def test_recent_users_window_is_inclusive_and_rows_distinct(frame):
    def job(job_id, created, table, dataset="d", user="u"):
        return {"job_id": job_id, "creation_time": created, "user_email": user, "query": "q",
                "referenced_tables": [("p", dataset, table), ("p", dataset, table)]}

    jobs = frame(
        "jobs",
        [
            job("end", AS_OF, "t"),
            job("start", AS_OF - 30 * DAY, "t"),
            job("before", AS_OF - 30 * DAY - dt.timedelta(seconds=1), "t"),
            job("after", AS_OF + dt.timedelta(seconds=1), "t"),
            job("twice", AS_OF, "t"),
            job("dataset", AS_OF - DAY, "t", dataset="e"),
            job("table", AS_OF - DAY, "x"),
        ],
    )
    naive = AS_OF.replace(tzinfo=None)
    rows = governance.recent_table_users(jobs, "d.t", AS_OF).collect()
    assert [r.creation_time for r in rows] == [naive, naive - 30 * DAY]
    rows = governance.recent_table_users(jobs, "t", AS_OF).collect()
    assert [r.creation_time for r in rows] == [naive, naive - DAY, naive - 30 * DAY]
    assert governance.recent_table_users(jobs, "t", AS_OF, k=1).count() == 1


def test_recommendations_pass_nested_columns_through(frame):
    rows = [
        {"recommendation_id": str(i), "recommender": r, "state": s,
         "last_updated_time": AS_OF - i * DAY, "target_resources": ["x", "y"],
         "primary_impact": ("COST",), "additional_details": "{}"}
        for i, (r, s) in enumerate([
            (f"{fv.MATERIALIZED_VIEW_PREFIX}.Recommender", "ACTIVE"),
            (f"{fv.MATERIALIZED_VIEW_PREFIX}X", "ACTIVE"),
            (f"{fv.MATERIALIZED_VIEW_PREFIX}.Recommender", "CLAIMED"),
            (f"x.{fv.MATERIALIZED_VIEW_PREFIX}", "ACTIVE"),
        ])
    ]
    found = recommendations.materialized_view_recommendations(frame("recommendations", rows))
    got = found.collect()
    assert len(got) == 2
    assert got[0].target_resources == ["x", "y"] and got[0].primary_impact.category == "COST"
    assert got[0].last_updated_time > got[1].last_updated_time
