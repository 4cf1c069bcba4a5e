"""The tables of the analysis: columns, partition column and the columns that rows are sorted by."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Table:
    columns: str
    partition: str | None = None
    cluster: tuple = ()


#: Names and types of the tables that results are stored in.
TABLES = {
    "ticker_metadata": Table("ticker STRING NOT NULL, company_name STRING, sector STRING, industry STRING, market_cap BIGINT, pe_ratio DOUBLE, exchange STRING, country STRING, last_updated TIMESTAMP, is_active BOOLEAN", None, ("ticker",)),
    "ff_factors": Table("date DATE NOT NULL, mkt_rf DOUBLE, smb DOUBLE, hml DOUBLE, rmw DOUBLE, cma DOUBLE, rf DOUBLE", None, ("date",)),
    "filtered_universe": Table("ticker STRING NOT NULL, is_valid BOOLEAN, reason STRING, n_days BIGINT, coverage DOUBLE, median_dollar_volume DOUBLE, market_cap DOUBLE, first_date DATE, last_date DATE, filter_date DATE", None, ("ticker",)),
    "rolling_residuals": Table("run_id STRING, window_end DATE NOT NULL, ticker STRING NOT NULL, date DATE NOT NULL, residual DOUBLE, factor_model STRING, window_start DATE", "window_start", ("ticker", "date")),
    "pair_results_raw": Table("ticker_i STRING NOT NULL, ticker_j STRING NOT NULL, lag BIGINT NOT NULL, dcor DOUBLE, p_value DOUBLE, permutations_used BIGINT, sharpness DOUBLE, sharpness_entropy DOUBLE, pearson_corr DOUBLE, window_start DATE", "window_start", ("ticker_i", "ticker_j")),
    "pair_results_filtered": Table("ticker_i STRING NOT NULL, ticker_j STRING NOT NULL, lag BIGINT, dcor DOUBLE, q_value DOUBLE, significant BOOLEAN, pearson_corr DOUBLE, window_start DATE", "window_start", ("ticker_i", "ticker_j")),
    "stability_metrics": Table("ticker_i STRING NOT NULL, ticker_j STRING NOT NULL, best_lag BIGINT, mean_dcor DOUBLE, variance_dcor DOUBLE, frequency DOUBLE, half_life DOUBLE, half_life_r2 DOUBLE, half_life_stable BOOLEAN, sharpness DOUBLE, n_windows_observed BIGINT, last_updated DATE", None, ("ticker_i", "ticker_j")),
    "oos_strategy_returns": Table("ticker_i STRING NOT NULL, ticker_j STRING NOT NULL, window_start DATE, lag BIGINT, signal DOUBLE, position BIGINT, strategy_return_gross DOUBLE, strategy_return_net DOUBLE, oos_date DATE", "oos_date", ("ticker_i", "ticker_j")),
    "model_weights": Table("model_version STRING NOT NULL, feature STRING NOT NULL, weight DOUBLE, ci_lower DOUBLE, ci_upper DOUBLE, r2 DOUBLE, f_statistic DOUBLE, n_pairs BIGINT, is_current BOOLEAN, refit_date DATE", "refit_date", ("model_version",)),
    "final_network": Table("ticker_i STRING NOT NULL, ticker_j STRING NOT NULL, best_lag BIGINT, mean_dcor DOUBLE, variance_dcor DOUBLE, frequency DOUBLE, half_life DOUBLE, sharpness DOUBLE, predicted_sharpe DOUBLE, signal_strength DOUBLE, oos_sharpe_net DOUBLE, oos_dcor DOUBLE, sector_i STRING, sector_j STRING, rank BIGINT, centrality_i DOUBLE, centrality_j DOUBLE, as_of_date DATE", "as_of_date", ("ticker_i", "ticker_j")),
    "synthetic_health_log": Table("true_positive_rate DOUBLE, false_positive_rate DOUBLE, stability_rank_accuracy DOUBLE, n_planted BIGINT, n_null BIGINT, alert_tpr BOOLEAN, alert_fpr BOOLEAN, status STRING, run_date DATE", "run_date"),
    "pipeline_run_log": Table("run_id STRING NOT NULL, window_start DATE, window_end DATE, n_pairs_processed BIGINT, n_significant_pairs BIGINT, tier3_fraction DOUBLE, cpu_hours_used DOUBLE, status STRING, error_message STRING, duration_seconds DOUBLE, run_date DATE", "run_date"),
    "quality_picks_scores": Table("ticker STRING NOT NULL, sector STRING, market_cap DOUBLE, pe_ratio DOUBLE, momentum_score DOUBLE, fundamental_quality_score DOUBLE, centrality_score DOUBLE, momentum_6m_return DOUBLE, centrality_raw DOUBLE, annualized_vol DOUBLE, updated_at DATE", "updated_at", ("ticker",)),
}
