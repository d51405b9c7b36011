"""Symbol and instrument dimensions (fixed values) as small DataFrames.

Both tables have a fixed size (under 100 rows), so joins against them may
broadcast them safely.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Market -> (label, provider ticker), in the reference's order.
# A label listed twice in the reference (BAC) appears once.
US_SYMBOLS = [
    ("AAPL", "AAPL"), ("BLK", "BLK"), ("ASML", "ASML"), ("MS", "MS"), ("GS", "GS"), ("STT", "STT"),
    ("NTRS", "NTRS"), ("BAC", "BAC"), ("MA", "MA"), ("C", "C"), ("BCS", "BCS"), ("UBS", "UBS"),
    ("DB", "DB"), ("MSFT", "MSFT"), ("GOOGL", "GOOGL"), ("AMZN", "AMZN"), ("META", "META"),
    ("TSLA", "TSLA"), ("BRK.B", "BRK-B"), ("NVDA", "NVDA"), ("JPM", "JPM"), ("V", "V"),
    ("NFLX", "NFLX"), ("DIS", "DIS"), ("XOM", "XOM"), ("CVX", "CVX"), ("JNJ", "JNJ"), ("PFE", "PFE"),
    ("MRK", "MRK"), ("UNH", "UNH"), ("LLY", "LLY"), ("BA", "BA"), ("LMT", "LMT"), ("NOC", "NOC"),
    ("F", "F"), ("GM", "GM"), ("WMT", "WMT"), ("PG", "PG"), ("KO", "KO"), ("PEP", "PEP"),
    ("CSCO", "CSCO"), ("ORCL", "ORCL"),
]
INDIAN_SYMBOLS = [
    ("RELIANCE", "RELIANCE.NS"), ("ONGC", "ONGC.NS"), ("TCS", "TCS.NS"), ("INFY", "INFY.NS"),
    ("HDFCBANK", "HDFCBANK.NS"), ("ICICIBANK", "ICICIBANK.NS"), ("KOTAKBANK", "KOTAKBANK.NS"),
    ("SBIN", "SBIN.NS"), ("AXISBANK", "AXISBANK.NS"), ("BAJFINANCE", "BAJFINANCE.NS"),
    ("HINDUNILVR", "HINDUNILVR.NS"), ("ITC", "ITC.NS"), ("ASIANPAINT", "ASIANPAINT.NS"),
    ("NESTLEIND", "NESTLEIND.NS"), ("MARUTI", "MARUTI.NS"), ("TATAMOTORS", "TATAMOTORS.NS"),
    ("M&M", "M&M.NS"), ("SUNPHARMA", "SUNPHARMA.NS"), ("DRREDDY", "DRREDDY.NS"), ("CIPLA", "CIPLA.NS"),
    ("APOLLOHOSP", "APOLLOHOSP.NS"), ("TATASTEEL", "TATASTEEL.NS"), ("JSWSTEEL", "JSWSTEEL.NS"),
    ("ULTRACEMCO", "ULTRACEMCO.NS"), ("HCLTECH", "HCLTECH.NS"), ("ADANIGREEN", "ADANIGREEN.NS"),
    ("ADANIPORTS", "ADANIPORTS.NS"), ("ADANIENT", "ADANIENT.NS"), ("BHARTIARTL", "BHARTIARTL.NS"),
    ("WIPRO", "WIPRO.NS"), ("TECHM", "TECHM.NS"), ("PARAS", "PARAS.NS"), ("HAL", "HAL.NS"),
    ("BEL", "BEL.NS"),
]
MARKETS = {"US Stocks": US_SYMBOLS, "Indian Stocks": INDIAN_SYMBOLS}

# Instrument details keyed by symbol (name, sector, industry, currency).
INSTRUMENTS = [
    ("AAPL", "Apple Inc.", "Technology", "Consumer Electronics", "USD"),
    ("BLK", "BlackRock, Inc.", "Financial Services", "Asset Management", "USD"),
    ("ASML", "ASML Holding N.V.", "Technology", "Semiconductors & Semiconductor Equipment", "USD"),
    ("MS", "Morgan Stanley", "Financial Services", "Capital Markets", "USD"),
    ("GS", "The Goldman Sachs Group, Inc.", "Financial Services", "Capital Markets", "USD"),
    ("STT", "State Street Corporation", "Financial Services", "Asset Management", "USD"),
    ("NTRS", "Northern Trust Corporation", "Financial Services", "Asset Management", "USD"),
    ("BAC", "Bank of America Corporation", "Financial Services", "Banks—Diversified", "USD"),
    ("MA", "Mastercard Incorporated", "Financial Services", "Credit Services", "USD"),
    ("BCS", "Barclays PLC", "Financial Services", "Banks—Diversified", "GBP"),
    ("C", "Citigroup Inc.", "Financial Services", "Banks—Diversified", "USD"),
    ("UBS", "UBS Group AG", "Financial Services", "Banks—Diversified", "CHF"),
    ("DB", "Deutsche Bank Aktiengesellschaft", "Financial Services", "Banks—Diversified", "EUR"),
    ("MSFT", "Microsoft Corporation", "Technology", "Software—Infrastructure", "USD"),
    ("GOOGL", "Alphabet Inc. (Class A)", "Communication Services", "Internet Content & Information", "USD"),
    ("AMZN", "Amazon.com Inc.", "Consumer Cyclical", "Internet Retail", "USD"),
    ("META", "Meta Platforms Inc.", "Communication Services", "Social Media", "USD"),
    ("TSLA", "Tesla Inc.", "Consumer Cyclical", "Auto Manufacturers", "USD"),
    ("BRK.B", "Berkshire Hathaway Inc.", "Financial Services", "Insurance—Diversified", "USD"),
    ("NVDA", "NVIDIA Corporation", "Technology", "Semiconductors", "USD"),
    ("JPM", "JPMorgan Chase & Co.", "Financial Services", "Banks—Diversified", "USD"),
    ("V", "Visa Inc.", "Financial Services", "Credit Services", "USD"),
    ("NFLX", "Netflix Inc.", "Communication Services", "Entertainment", "USD"),
    ("DIS", "The Walt Disney Company", "Communication Services", "Entertainment", "USD"),
    ("XOM", "Exxon Mobil Corporation", "Energy", "Oil & Gas Integrated", "USD"),
    ("CVX", "Chevron Corporation", "Energy", "Oil & Gas Integrated", "USD"),
    ("JNJ", "Johnson & Johnson", "Healthcare", "Drug Manufacturers—General", "USD"),
    ("PFE", "Pfizer Inc.", "Healthcare", "Drug Manufacturers—General", "USD"),
    ("MRK", "Merck & Co., Inc.", "Healthcare", "Drug Manufacturers—General", "USD"),
    ("UNH", "UnitedHealth Group Incorporated", "Healthcare", "Healthcare Plans", "USD"),
    ("LLY", "Eli Lilly and Company", "Healthcare", "Drug Manufacturers—General", "USD"),
    ("BA", "The Boeing Company", "Industrials", "Aerospace & Defense", "USD"),
    ("LMT", "Lockheed Martin Corporation", "Industrials", "Aerospace & Defense", "USD"),
    ("NOC", "Northrop Grumman Corporation", "Industrials", "Aerospace & Defense", "USD"),
    ("F", "Ford Motor Company", "Consumer Cyclical", "Auto Manufacturers", "USD"),
    ("GM", "General Motors Company", "Consumer Cyclical", "Auto Manufacturers", "USD"),
    ("WMT", "Walmart Inc.", "Consumer Defensive", "Discount Stores", "USD"),
    ("PG", "Procter & Gamble Company", "Consumer Defensive", "Household & Personal Products", "USD"),
    ("KO", "Coca-Cola Company", "Consumer Defensive", "Beverages—Non-Alcoholic", "USD"),
    ("PEP", "PepsiCo Inc.", "Consumer Defensive", "Beverages—Non-Alcoholic", "USD"),
    ("CSCO", "Cisco Systems Inc.", "Technology", "Communication Equipment", "USD"),
    ("ORCL", "Oracle Corporation", "Technology", "Software—Infrastructure", "USD"),
    ("RELIANCE", "Reliance Industries Limited", "Energy", "Oil & Gas", "INR"),
    ("ONGC", "Oil & Natural Gas Corporation", "Energy", "Oil & Gas", "INR"),
    ("TCS", "Tata Consultancy Services", "Technology", "IT Services", "INR"),
    ("INFY", "Infosys Limited", "Technology", "IT Services", "INR"),
    ("HDFCBANK", "HDFC Bank Limited", "Financial Services", "Banking", "INR"),
    ("ICICIBANK", "ICICI Bank Limited", "Financial Services", "Banking", "INR"),
    ("KOTAKBANK", "Kotak Mahindra Bank Limited", "Financial Services", "Banking", "INR"),
    ("SBIN", "State Bank of India", "Financial Services", "Banking", "INR"),
    ("AXISBANK", "Axis Bank Limited", "Financial Services", "Banking", "INR"),
    ("BAJFINANCE", "Bajaj Finance Limited", "Financial Services", "NBFC", "INR"),
    ("HINDUNILVR", "Hindustan Unilever Limited", "Consumer Defensive", "Household & Personal Products", "INR"),
    ("ITC", "ITC Limited", "Consumer Defensive", "Tobacco & FMCG", "INR"),
    ("ASIANPAINT", "Asian Paints Limited", "Consumer Cyclical", "Specialty Chemicals", "INR"),
    ("NESTLEIND", "Nestle India Limited", "Consumer Defensive", "Packaged Foods", "INR"),
    ("MARUTI", "Maruti Suzuki India Limited", "Consumer Cyclical", "Auto Manufacturers", "INR"),
    ("TATAMOTORS", "Tata Motors Limited", "Consumer Cyclical", "Auto Manufacturers", "INR"),
    ("M&M", "Mahindra & Mahindra Limited", "Consumer Cyclical", "Auto Manufacturers", "INR"),
    ("SUNPHARMA", "Sun Pharmaceutical Industries Limited", "Healthcare", "Drug Manufacturers—Specialty & Generic", "INR"),
    ("DRREDDY", "Dr. Reddy's Laboratories Limited", "Healthcare", "Drug Manufacturers—Specialty & Generic", "INR"),
    ("CIPLA", "Cipla Limited", "Healthcare", "Drug Manufacturers—Specialty & Generic", "INR"),
    ("APOLLOHOSP", "Apollo Hospitals Enterprise Limited", "Healthcare", "Hospitals & Healthcare Facilities", "INR"),
    ("TATASTEEL", "Tata Steel Limited", "Basic Materials", "Steel", "INR"),
    ("JSWSTEEL", "JSW Steel Limited", "Basic Materials", "Steel", "INR"),
    ("ULTRACEMCO", "UltraTech Cement Limited", "Basic Materials", "Cement", "INR"),
    ("ADANIGREEN", "Adani Green Energy Limited", "Utilities", "Renewable Energy", "INR"),
    ("ADANIPORTS", "Adani Ports and SEZ Limited", "Industrials", "Logistics & Ports", "INR"),
    ("ADANIENT", "Adani Enterprises Limited", "Conglomerate", "Diversified Holdings", "INR"),
    ("BHARTIARTL", "Bharti Airtel Limited", "Communication Services", "Telecom Services", "INR"),
    ("WIPRO", "Wipro Limited", "Technology", "IT Services", "INR"),
    ("TECHM", "Tech Mahindra Limited", "Technology", "IT Services", "INR"),
    ("PARAS", "Paras Defence and Space Technologies Ltd.", "Industrials", "Defense & Aerospace", "INR"),
    ("HAL", "Hindustan Aeronautics Limited", "Industrials", "Defense & Aerospace", "INR"),
    ("BEL", "Bharat Electronics Limited", "Industrials", "Defense & Aerospace", "INR"),
]

# Defaults for an instrument that is not listed.
DEFAULT_SECTOR, DEFAULT_INDUSTRY, DEFAULT_CURRENCY = "Unknown", "Unknown", "USD"


def symbol_table(spark: SparkSession) -> DataFrame:
    rows = [(m, label, t) for m, pairs in MARKETS.items() for label, t in pairs]
    return spark.createDataFrame(rows, "market string, label string, ticker string")


def instrument_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(INSTRUMENTS, "key string, name string, sector string, industry string, currency string")


def values_sql(rows: list[tuple], cols: list[str]) -> str:
    """The same rows as a SQL VALUES list (for the oracle)."""
    def q(v: str) -> str:
        return "'" + v.replace("'", "''") + "'"

    body = ", ".join("(" + ", ".join(q(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS t({', '.join(cols)})"


def symbol_rows() -> list[tuple]:
    return [(m, label, t) for m, pairs in MARKETS.items() for label, t in pairs]
