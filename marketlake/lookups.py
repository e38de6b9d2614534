"""Fixed values. They must equal the values users already get, so they stand here as plain text,
in their natural order (the order decides which entry wins)."""

# --- fixed values: labels of the quote providers ---------------------------------------------
SOURCE_A = "Alpha Vantage"
SOURCE_B = "Finnhub"
SOURCE_STATIC = "static"
SOURCE_NONE = "none"

# --- fixed values: last-resort quotes (symbol, price, change, name, volume) -------------------
STATIC_QUOTES = [
    ("AAPL", 175.64, 2.32, "Apple Inc.", 78523641),
    ("MSFT", 380.32, 4.21, "Microsoft Corporation", 32458726),
    ("GOOGL", 142.93, 1.56, "Alphabet Inc.", 25843197),
    ("AMZN", 169.45, -0.87, "Amazon.com Inc.", 41236548),
    ("META", 458.32, 5.43, "Meta Platforms Inc.", 19876543),
    ("TSLA", 193.57, -2.31, "Tesla Inc.", 57234891),
    ("NVDA", 788.14, 12.47, "NVIDIA Corporation", 45213698),
]

# --- fixed values: company facts (symbol, name, sector, business, products) -------------------
COMPANIES = [
    ("AAPL", "Apple Inc.", "Technology", "Consumer electronics, software, and services",
     "iPhone, iPad, Mac, Apple Watch, Services (App Store, Apple Music, iCloud)"),
    ("MSFT", "Microsoft Corporation", "Technology", "Software, cloud computing, and hardware",
     "Windows, Office 365, Azure, Surface devices, Xbox"),
    ("GOOGL", "Alphabet Inc.", "Technology", "Internet services and products",
     "Google Search, YouTube, Android, Google Cloud, Advertising"),
    ("AMZN", "Amazon.com Inc.", "Consumer Cyclical", "E-commerce, cloud computing, and digital streaming",
     "Online marketplace, AWS, Prime Video, Alexa, Kindle"),
    ("META", "Meta Platforms Inc.", "Technology", "Social media and virtual reality",
     "Facebook, Instagram, WhatsApp, Oculus VR"),
    ("TSLA", "Tesla Inc.", "Automotive", "Electric vehicles and clean energy",
     "Model S, Model 3, Model X, Model Y, Powerwall, Solar Roof"),
    ("NVDA", "NVIDIA Corporation", "Technology", "Graphics processing units and artificial intelligence",
     "GPUs, Gaming, Data Center, Professional Visualization, Automotive"),
]
UNKNOWN_PRODUCTS = "Various products and services in their industry"

# --- fixed values: question keyword -> answer, first hit wins ---------------------------------
FAQ = [
    ("what is a stock", "A stock represents ownership in a company. When you buy a stock, you're purchasing a small piece of that company, which makes you a shareholder."),
    ("what is investing", "Investing is allocating money with the expectation of generating income or profit over time. Common investments include stocks, bonds, mutual funds, and real estate."),
    ("how do i start investing", "To start investing, first establish an emergency fund, set clear goals, open a brokerage account, learn basic investment concepts, start with diversified investments like index funds, and consider dollar-cost averaging."),
    ("what is a bear market", "A bear market is when a market experiences prolonged price declines, typically a drop of 20% or more from recent highs. It's often accompanied by negative investor sentiment and pessimism."),
    ("what is a bull market", "A bull market refers to a financial market condition where prices are rising or expected to rise. It's characterized by optimism, investor confidence, and strong economic indicators."),
    ("what is diversification", "Diversification is spreading investments across various assets to reduce risk. By not 'putting all your eggs in one basket,' you can potentially minimize losses during market downturns."),
    ("what is the s&p 500", "The S&P 500 is a stock market index that tracks the performance of 500 large companies listed on U.S. stock exchanges. It's widely regarded as a gauge of the overall U.S. stock market performance."),
    ("what is a dividend", "A dividend is a payment made by a corporation to its shareholders as a distribution of profits. Companies may issue dividends regularly, typically quarterly."),
]
FAQ_DEFAULT = "I'm currently operating in offline mode with limited capabilities. When online, I can provide detailed financial analysis and personalized responses to your questions. For now, I can answer basic financial questions - try asking about stocks, investing basics, or market terminology."

# --- fixed values: query keyword -> news category, every hit counts ---------------------------
TOPIC_KEYWORDS = [
    ("apple", "companies"), ("microsoft", "companies"), ("amazon", "companies"),
    ("google", "companies"), ("meta", "companies"), ("tesla", "companies"),
    ("market", "markets"), ("stock", "markets"), ("tech", "technology"),
    ("economy", "economy"), ("inflation", "economy"), ("interest", "economy"),
]
TOPICS = ["markets", "technology", "economy", "companies"]

# --- fixed values: sample account -------------------------------------------------------------
SEED_USERNAME = "test"
SEED_EMAIL = "test@example.com"
SEED_POSITIONS = [("AAPL", 10, 175.50), ("MSFT", 5, 380.25), ("GOOGL", 3, 142.90)]

# --- fixed values: texts around a prompt ------------------------------------------------------
CONTEXT_LEAD = "Here is some context that might be helpful: "
DATA_LEAD = "Here is the available data for %s: "
OVERVIEW = "# %s (%s) Analysis\n\n%s operates in the %s sector, focusing on %s. Their main products/services include %s."
UNKNOWN_BUSINESS = "Business operations in the %s sector"
NO_SUMMARY = "No summary available"
NO_SOURCE = "Financial News"

# --- fixed values: reject reasons -------------------------------------------------------------
MISSING_FIELDS = "Missing required fields"
USERNAME_TAKEN = "Username already exists"
EMAIL_TAKEN = "Email already exists"
NOT_ENOUGH_SHARES = "Not enough shares to sell"
