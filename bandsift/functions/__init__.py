"""Column expressions; no operator here touches a DataFrame."""
