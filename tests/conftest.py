import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

@pytest.fixture(scope="session")
def spark():
    from tablewise.session import get_session

    s = get_session(master="local[*]", shuffle_partitions=8, app="tablewise-tests")
    yield s


@pytest.fixture(scope="session")
def employees(spark):
    """Employees, 5 rows: strings as a spreadsheet delivers them (mixed-locale salaries)."""
    rows = [
        ("E001", "Alice Martin", "F", "Sales", "2024-01-15", "3 200,00", 38400),
        ("E002", "Bob Diallo", "M", "Engineering", "2023-09-01", "5,500.00", 66000),
        ("E003", "Chen Wei", "M", "Sales", "2024-06-01", "$3,800", 45600),
        ("E004", "Dora Nkosi", "F", "HR", "2022-03-12", "2 900", 34800),
        ("E005", "Eric Toure", "M", "Engineering", "2023-11-30", "5 100,50", 61206),
    ]
    schema = "`No` string, `Name` string, `Gender` string, `Department` string, `Start Date` string, `Monthly Salary` string, `Annual Salary` long"
    return spark.createDataFrame(rows, schema)
