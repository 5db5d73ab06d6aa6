"""Small hand-made business tables."""

from datetime import date

from tallygrain.schemas import SCHEMAS, Tables


def rows(spark, name, values):
    return spark.createDataFrame(values, SCHEMAS[name])


def d(text):
    return date.fromisoformat(text)


def money(value):
    from decimal import Decimal

    return None if value is None else Decimal(str(value))


def valid_tables(spark) -> Tables:
    """Four customers that keep every rule of the contract."""
    customers = [
        ("C1", "One", "Europe", "FR", "Retail", "Small", "Direct", d("2023-01-01"), "active"),
        ("C2", "Two", "Europe", "DE", None, "Medium", "Online", d("2023-02-01"), "inactive"),
        ("C3", "Three", "India", "IN", "Retail", "Enterprise", "Direct", d("2023-03-01"), "active"),
        ("C4", "Four", "APAC", "JP", "Bank", "Small", "Partner", d("2023-04-01"), "active"),
    ]
    subscriptions = [
        ("S1", "C1", "Basic", d("2023-01-10"), d("2024-01-10"), None, money(100), 5, "active"),
        ("S2", "C2", "Professional", d("2023-02-10"), d("2024-02-10"), d("2024-03-15"), money(200), 10, "cancelled"),
        ("S3", "C3", "Enterprise", d("2023-03-10"), d("2024-03-09"), None, money(900), 50, "active"),
        ("S4", "C3", "Basic", d("2023-05-10"), d("2024-05-09"), d("2023-12-01"), money(90), 2, "expired"),
        ("S5", "C4", "Professional", d("2023-04-10"), d("2024-04-09"), None, money(210), 8, "active"),
    ]
    sales = [
        ("A1", "C1", "S1", d("2024-01-05"), "Europe", "Basic", money(100), money(10), money(90), "web"),
        ("A2", "C2", "S2", d("2024-01-06"), "Europe", "Professional", money(200), money(0), money(200), "web"),
        ("A3", "C3", "S3", d("2024-02-05"), "India", "Enterprise", money(900), money(90), money(810), "desk"),
        ("A4", "C3", "S4", d("2024-04-05"), "India", "Basic", money(90), money(0), money(90), "web"),
        ("A5", "C1", "S1", d("2024-04-06"), "Europe", "Basic", money(110), money(11), money(99), "web"),
    ]
    costs = [
        (f"K{day}", d(f"2024-01-{day:02d}"), "Europe", "api", money(1), money(2), money(3), money(4), money(10))
        for day in range(1, 5)
    ]
    tickets = [
        ("T1", "C1", d("2024-01-02"), d("2024-01-03"), "bug", "Low", money(5), money(4.5), "resolved"),
        ("T2", "C1", d("2024-01-02"), d("2024-01-03"), "bug", "Low", money(5), money(4.5), "resolved"),
        ("T3", "C2", d("2024-03-01"), d("2024-03-02"), "bug", "High", money(20), None, "resolved"),
        ("T4", "C2", d("2024-04-01"), None, "billing", "Low", money(8), money(2.0), "open"),
        ("T5", "C3", d("2024-02-01"), d("2024-02-01"), "bug", "Critical", money(1), money(5.0), "resolved"),
    ]
    return Tables(
        customers=rows(spark, "customers", customers),
        subscriptions=rows(spark, "subscriptions", subscriptions),
        sales=rows(spark, "sales", sales),
        cloud_costs=rows(spark, "cloud_costs", costs),
        support_tickets=rows(spark, "support_tickets", tickets),
    )
