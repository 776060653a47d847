"""Query plans over the driver's tables: fixtures (roles), queries and oracles."""
