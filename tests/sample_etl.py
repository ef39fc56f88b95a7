"""The sample ETL fixture (FIXTURES.md A-C) as Spark views: a source store
(sales, customers, products), a target store (sale_fact, products_dim,
geo_dim, customers_dim) and the eight-row mapping document."""

import datetime as dt
from decimal import Decimal as D

D1 = dt.date

# The rows of the sample tables, and below the mapping document.
CUSTOMERS = [(1, None, "SR", None), (2, None, "SR", None), (3, None, "NR", None), (4, None, "ER", None),
             (5, None, "SR", None), (6, None, "SR", None), (7, None, "SR", None), (8, None, "SR", None),
             (9, None, "SR", None), (10, None, "SR", None)]
TS = dt.datetime(2026, 2, 22, 16, 6, 58, 151000)
SALES = [
    (1, 7, 4, 5, D("63.32"), D1(2025, 12, 1), D("0.1368"), TS),
    (2, 4, 8, 1, D("14.18"), D1(2025, 12, 6), D("0.0880"), TS),
    (3, 8, 8, 10, D("64.68"), D1(2025, 12, 11), D("0.0244"), TS),
    (4, 5, 3, 6, D("25.35"), D1(2025, 12, 16), D("0.0990"), TS),
    (5, 7, 6, 9, D("15.85"), D1(2025, 12, 21), D("0.0069"), TS),
    (6, 10, 5, 1, D("95.40"), D1(2025, 12, 26), D("0.1819"), TS),
    (7, 3, 2, 10, D("96.91"), D1(2025, 12, 31), D("0.0518"), TS),
    (8, 7, 8, 3, D("82.76"), D1(2026, 1, 5), D("0.1325"), TS),
    (9, 8, 6, 7, D("37.42"), D1(2026, 1, 10), D("0.0623"), TS),
    (10, 5, 2, 4, D("18.79"), D1(2026, 1, 15), D("0.1040"), TS),
]
PRODUCTS = [(i, None, f"Cat_{i}", None, None) for i in range(1, 11)]
SALE_FACT = [
    ("00ac8ed3b4327bdd4ebbebcb2ba10a00", 10, 5, 202512, D("95.4"), D("78.05")),
    ("1ff1de774005f8da13f42943881c655f", 4, 8, 202512, D("14.18"), D("12.93")),
    ("65b9eea6e1cc6bb9f0cd2a47751a186f", 5, 2, 202601, D("75.16"), D("67.34")),
    ("6c8349cc7260ae62e3b1396831a8398f", 5, 3, 202512, D("152.1"), D("137.04")),
    ("70efdf2ec9b086079795c442636b55fb", 7, 4, 202512, D("316.6"), D("273.27")),
    ("72b32a1f754ba1c09b3695e0cb6cde7f", 7, 6, 202512, D("142.65"), D("141.67")),
    ("a5771bce93e200c36f7cd9dfd0e5deaa", 8, 8, 202512, D("646.8"), D("631.01")),
    ("c7e1249ffc03eb9ded908c236bd1996d", 7, 8, 202601, D("248.28"), D("215.38")),
    ("d2ddea18f00665ce8623e36bd4e3c7c5", 3, 2, 202512, D("969.1"), D("918.94")),
    ("ed3d2c21991e3bef5e069713af9fa6ca", 8, 6, 202601, D("261.94"), D("245.61")),
]
PRODUCTS_DIM = [(i, i, None, f"Cat_{i}", None) for i in range(1, 11)]
GEO_DIM = [(1, "North", "NR"), (2, "South", "SR"), (3, "East", "ER")]
OPEN = D1(9999, 12, 31)
CUSTOMERS_DIM = [
    (1, 1, "Acme Corp", "NR", D1(2025, 12, 1), OPEN, 1), (2, 2, "Tech Ltd", "SR", D1(2025, 12, 1), OPEN, 1),
    (3, 3, "Global Inc", "ER", D1(2025, 12, 1), OPEN, 1), (4, 4, "RetailMax", "NR", D1(2025, 12, 1), OPEN, 1),
    (5, 5, "DataWorks", "SR", D1(2025, 12, 1), OPEN, 1), (6, 6, "CloudPeak", "ER", D1(2025, 12, 1), OPEN, 1),
    (7, 7, "SysNova", "NR", D1(2025, 12, 1), OPEN, 1), (8, 8, "InfoGrid", "SR", D1(2025, 12, 1), OPEN, 1),
    (9, 9, "NetForge", "ER", D1(2025, 12, 1), OPEN, 1), (10, 10, "ByteZone", "NR", D1(2025, 12, 1), OPEN, 1),
    (11, 11, "Acme Corp Updated", "NR", D1(2026, 2, 1), OPEN, 1),
    (12, 12, "Acme Corp", "NR", D1(2025, 12, 1), D1(2026, 2, 1), 0),
]

# The mapping document.
MAPPING_CSV = '''"MapID","Src Table","Src Field","PG Type","Rule/Transform","Tgt Table","Tgt Field","MySQL Type","Key","DQ Rule"
"S001","sales","sale_id","BIGINT","MD5(sale_id+cust_id)::CHAR(32)","sale_fact","sale_sk","CHAR(32)","Y","NOT NULL"
"S002","sales","cust_id","INT","SCD2 lookup customers_dim","sale_fact","cust_sk","BIGINT","Y","FK EXISTS"
"S003","sales","prod_id","INT","JOIN products → prod_sk","sale_fact","prod_sk","BIGINT","Y","FK EXISTS"
"S004","sales","qty","INTEGER","qty * unit_price","sale_fact","gross_amt","DECIMAL(12,2)","N",">0"
"S005","sales","sale_date","DATE","YEAR(sale_date)*100+MONTH()","sale_fact","period_key","INT","Y","YYYYMM"
"S006","sales","disc_pct","NUMERIC(5,4)","(1-disc_pct)*gross_amt","sale_fact","net_amt","DECIMAL(12,2)","N","0-1 range"
"S007","customers","region","VARCHAR(2)","CASE 'NR'→1,'SR'→2,'ER'→3","geo_dim","geo_sk","TINYINT","Y","ENUM 1-3"
"S008","products","category","VARCHAR(30)","SUBSTR(category,1,20)","products_dim","cat_name","VARCHAR(20)","N","LEN≤20"'''


def register(spark):
    """Create the seven tables as temp views; returns {name: DataFrame}."""
    t = {
        "customers": spark.createDataFrame(CUSTOMERS, "cust_id int, cust_name string, region string, join_date date"),
        "sales": spark.createDataFrame(SALES, "sale_id bigint, cust_id int, prod_id int, qty int, "
                                              "unit_price decimal(10,2), sale_date date, disc_pct decimal(5,4), "
                                              "created_ts timestamp"),
        "products": spark.createDataFrame(PRODUCTS, "prod_id int, prod_name string, category string, "
                                                    "unit_price decimal(10,2), created_date date"),
        "sale_fact": spark.createDataFrame(
            [r + (None, None) for r in SALE_FACT],
            "sale_sk string, cust_sk bigint, prod_sk bigint, period_key int, gross_amt decimal(12,2), "
            "net_amt decimal(12,2), geo_sk tinyint, etl_batch string"),
        "products_dim": spark.createDataFrame(PRODUCTS_DIM, "prod_sk bigint, prod_id int, prod_name string, "
                                                            "cat_name string, base_price decimal(10,2)"),
        "geo_dim": spark.createDataFrame(GEO_DIM, "geo_sk tinyint, region_name string, zone_code string"),
        "customers_dim": spark.createDataFrame(CUSTOMERS_DIM, "cust_sk bigint, cust_id int, cust_name string, "
                                                              "region string, valid_from date, valid_to date, "
                                                              "is_current tinyint"),
    }
    for name, df in t.items():
        df.createOrReplaceTempView(name)
    return t
