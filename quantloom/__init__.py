"""Cross-sectional signal research and backtest audit on Spark."""
