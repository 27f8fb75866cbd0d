from quillon.functions.money import net_units, units_to_money

__all__ = ["net_units", "units_to_money"]
