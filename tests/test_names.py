"""Column naming."""
from tablewise.functions import names as N


def test_scrub_and_dedupe():
    assert N.scrub_label("Salaire Mensuel (€)") == "salaire_mensuel"
    assert N.scrub_label("2nd value") == "c_2nd_value"
    assert N.scrub_label("") == "column"
    assert N.dedupe_names(["Foo", "foo"]) == ["foo", "foo_2"]
    # a suffix that collides with a real name is skipped
    assert N.dedupe_names(["a", "a_2", "a"]) == ["a", "a_2", "a_3"]


def test_readable_names_and_labels(employees):
    renamed, mapping, labels = N.rename_readable(employees)
    assert mapping["No"] == "employee_id"
    assert mapping["Name"] == "employee_name"
    assert mapping["Monthly Salary"] == "monthly_salary"
    assert labels["monthly_salary"] == "Salaire mensuel"
    assert renamed.columns[:2] == ["employee_id", "employee_name"]
    assert N.column_label("sick_leaves") == "Sick leaves"


def test_resolve_column():
    cols = {"monthly_salary": {"label": "Salaire mensuel", "original_name": "Monthly Salary"}}
    assert N.resolve_column("SALAIRE   mensuel", cols) == "monthly_salary"
    assert N.resolve_column("monthly-salary", cols) == "monthly_salary"
    assert N.resolve_column("ghost", cols) is None


def test_table_names():
    t = N.table_name("clean", "Ventes 2024")
    assert t.startswith("bi_clean_ventes_2024_") and len(t) <= 60
    assert N.quote_identifier("abc_1") == "`abc_1`"
