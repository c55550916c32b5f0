"""The layers put together: bronze, silver, gold, reports and governed access."""
