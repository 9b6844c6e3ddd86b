"""Published result tables (fixed values) used as goldens for the ranking operators.

Per-fold results: model, fold, mae, rmse, r2, wape, fit_seconds. Rankings as published.
"""

FULL_RESULTS = [
    ('global_median', 'validate_july', 1144.3714393322475, 1555.0789634572764, -0.06795522207425875, 0.47382801867891144, 0.0008283999995910563),
    ('global_median', 'validate_august', 1111.351385795335, 1507.3191458920437, -0.044550949200816925, 0.4752598976647854, 0.00169830000231741),
    ('global_median', 'validate_september', 1151.1144625267668, 1570.0829291771606, -0.06233723752637821, 0.47836057752485955, 0.0006996000010985881),
    ('global_median', 'validate_october', 1146.7937069853701, 1567.9704854490194, -0.05223503666552376, 0.4820382272202666, 0.0007859999968786724),
    ('global_median', 'validate_sep_oct', 1148.923725716686, 1569.4241791607556, -0.05764958163404699, 0.48022890531759843, 0.0007877000025473535),
    ('distance_linear', 'validate_july', 191.28090821766705, 657.8173352483727, 0.8089008395590129, 0.0792000312457692, 0.06395859999611275),
    ('distance_linear', 'validate_august', 189.1744442544446, 631.1167746222427, 0.8168787922375874, 0.0808988301686584, 0.002105799998389557),
    ('distance_linear', 'validate_september', 201.51152862296757, 639.6224859153967, 0.823694984474736, 0.08374073504246202, 0.002152399996703025),
    ('distance_linear', 'validate_october', 192.7741904419588, 668.2130277041988, 0.8088972799553176, 0.08102985606603905, 0.002580399996077176),
    ('distance_linear', 'validate_sep_oct', 196.9501468558285, 654.4156404400273, 0.8161056169339608, 0.08232152518890327, 0.0029298999943421222),
    ('equipment_median_rpm', 'validate_july', 209.59161288095027, 661.1973990064306, 0.8069319439510461, 0.0867815948998576, 0.007081899995682761),
    ('equipment_median_rpm', 'validate_august', 241.1093818845451, 667.6403099712094, 0.7950705865017338, 0.10310836124837586, 0.006021399996825494),
    ('equipment_median_rpm', 'validate_september', 227.3228443336537, 657.0658007591788, 0.8139477406757212, 0.09446696279129736, 0.007036900002276525),
    ('equipment_median_rpm', 'validate_october', 231.30495570141687, 683.8653433130296, 0.7998395899450672, 0.09722570861212068, 0.006985499996517319),
    ('equipment_median_rpm', 'validate_sep_oct', 229.09657316845033, 670.6599545300177, 0.8068628254206316, 0.09575813788340864, 0.005876900002476759),
    ('ridge_log_full_abs_weight', 'validate_july', 184.89175212388443, 665.9110381542617, 0.8041693892057757, 0.07655459544678264, 0.7365617999967071),
    ('ridge_log_full_abs_weight', 'validate_august', 165.51892326690674, 643.4081329996241, 0.8096765552833118, 0.07078274930760944, 0.8193758000052185),
    ('ridge_log_full_abs_weight', 'validate_september', 188.97123829683605, 647.722380752226, 0.8192014145174297, 0.07852945439399374, 0.9358498000001418),
    ('ridge_log_full_abs_weight', 'validate_october', 169.55897585399043, 668.6935192319007, 0.8086223489146666, 0.07127167478517062, 1.1534597000063513),
    ('ridge_log_full_abs_weight', 'validate_sep_oct', 217.3268311906797, 673.6993394563971, 0.8051082898282799, 0.09083860303584547, 0.947050799994031),
    ('hgb_mae_full_abs_weight', 'validate_july', 124.40562975335928, 632.0883665316017, 0.8235572794839461, 0.05151026234360809, 3.762621699999727),
    ('hgb_mae_full_abs_weight', 'validate_august', 127.7737807713844, 620.4800797395161, 0.8229993409873668, 0.05464136253377024, 1.5071354000028805),
    ('hgb_mae_full_abs_weight', 'validate_september', 122.72470323422296, 625.2551675178651, 0.8315264214588176, 0.050999845651165894, 1.597598399996059),
    ('hgb_mae_full_abs_weight', 'validate_october', 121.00500185292593, 648.3093494142663, 0.8201122619380153, 0.050862710723536965, 1.6431563999940408),
    ('hgb_mae_full_abs_weight', 'validate_sep_oct', 123.95645945656742, 640.2449259707041, 0.8239834865928352, 0.05181151150372498, 2.0297510999953374),
    ('hgb_mae_full_missing_bad_weight', 'validate_july', 122.03883757826875, 631.4694930440166, 0.8239026181143771, 0.050530289925210206, 1.3320603000029223),
    ('hgb_mae_full_missing_bad_weight', 'validate_august', 129.02578067906583, 622.4104664951524, 0.8218962879094359, 0.05517676956669095, 1.4317605000032927),
    ('hgb_mae_full_missing_bad_weight', 'validate_september', 123.24030853879864, 626.0440309299154, 0.8311010383886301, 0.0512141121375154, 1.531427200003236),
    ('hgb_mae_full_missing_bad_weight', 'validate_october', 122.154870986916, 649.2287391432271, 0.8196016902199443, 0.051346041662229454, 1.6834088000032352),
    ('hgb_mae_full_missing_bad_weight', 'validate_sep_oct', 124.94361627663172, 640.968227278233, 0.8235855611005358, 0.052224124829105274, 1.7456438000008347),
    ('extra_trees_full_abs_weight', 'validate_july', 200.7340746123843, 682.6042012815046, 0.7942281014025705, 0.08311412325217632, 2.405309400004626),
    ('extra_trees_full_abs_weight', 'validate_august', 196.78476846248432, 656.5803197588749, 0.8018039845524447, 0.08415332010814805, 2.8567846000005375),
    ('extra_trees_full_abs_weight', 'validate_september', 129.5723149666055, 623.8990209965144, 0.8322564500749305, 0.05384545971440884, 3.377329599999939),
    ('extra_trees_full_abs_weight', 'validate_october', 161.99864581334077, 663.1308829001, 0.8117931180894059, 0.06809379887968191, 3.894199000002118),
    ('extra_trees_full_abs_weight', 'validate_sep_oct', 135.09348830961744, 640.2405129474333, 0.8239859130464038, 0.05646658394663628, 3.4082943000030355),
]

SCENARIO_RESULTS = [
    ('december_equipment_median_rpm', 'validate_july', 209.59161288095027, 661.1973990064306, 0.8069319439510461, 0.0867815948998576, 0.007147800002712756),
    ('december_equipment_median_rpm', 'validate_august', 241.1093818845451, 667.6403099712094, 0.7950705865017338, 0.10310836124837586, 0.005828100001963321),
    ('december_equipment_median_rpm', 'validate_september', 227.3228443336537, 657.0658007591788, 0.8139477406757212, 0.09446696279129736, 0.007071300002280623),
    ('december_equipment_median_rpm', 'validate_october', 231.30495570141687, 683.8653433130296, 0.7998395899450672, 0.09722570861212068, 0.007201799999165814),
    ('december_equipment_median_rpm', 'validate_sep_oct', 229.09657316845033, 670.6599545300177, 0.8068628254206316, 0.09575813788340864, 0.005599099997198209),
    ('december_ridge_log_abs_weight', 'validate_july', 185.77525031082703, 665.6419727892734, 0.8043276103093331, 0.07692040866182556, 0.6247206000043661),
    ('december_ridge_log_abs_weight', 'validate_august', 168.5724280648833, 646.6168474001337, 0.8077735132516464, 0.07208855447090325, 0.7364459000018542),
    ('december_ridge_log_abs_weight', 'validate_september', 206.04043561357364, 654.9200837676809, 0.8151609027478746, 0.08562278121085712, 0.8612702000027639),
    ('december_ridge_log_abs_weight', 'validate_october', 228.49777952577807, 689.4853618323201, 0.7965362277592426, 0.09604575251456147, 1.0023020000007818),
    ('december_ridge_log_abs_weight', 'validate_sep_oct', 275.5723631758285, 703.3749979018368, 0.7875606435107704, 0.1151841600460996, 0.9119635000024573),
    ('december_hgb_mae_abs_weight', 'validate_july', 143.16928836526824, 628.241371118991, 0.825698463550073, 0.0592793719855231, 1.3580167999971309),
    ('december_hgb_mae_abs_weight', 'validate_august', 101.03828102179173, 615.0826210056287, 0.8260653492214669, 0.043208155145528164, 1.4130415999970865),
    ('december_hgb_mae_abs_weight', 'validate_september', 110.21442308972946, 618.5004858746428, 0.8351468266101895, 0.045801036123761026, 1.4775815999964834),
    ('december_hgb_mae_abs_weight', 'validate_october', 110.18284951866373, 648.2726055030083, 0.8201326521785081, 0.04631377476919799, 1.5760958999962895),
    ('december_hgb_mae_abs_weight', 'validate_sep_oct', 114.83187813531208, 636.206077238939, 0.8261972074666666, 0.04799760497424281, 1.4384104999990086),
    ('december_extra_trees_abs_weight', 'validate_july', 252.0702374982766, 698.7488523106244, 0.784379342524894, 0.1043699074414373, 2.060702399998263),
    ('december_extra_trees_abs_weight', 'validate_august', 196.99585518947111, 654.6317890235154, 0.802978610009079, 0.08424358953827464, 2.5522577999945497),
    ('december_extra_trees_abs_weight', 'validate_september', 140.48681601016278, 629.5157216021723, 0.829222605732618, 0.0583811224938784, 2.950388600002043),
    ('december_extra_trees_abs_weight', 'validate_october', 145.4822099743118, 659.7287511144418, 0.8137193203515337, 0.061151352820423596, 3.2123448999991524),
    ('december_extra_trees_abs_weight', 'validate_sep_oct', 140.85895198244629, 643.7476951197565, 0.8220522513982443, 0.05887644131686672, 2.8187603999977),
]

FULL_RANKINGS = [
    ('hgb_mae_full_abs_weight', 123.973115013692, 633.2755778347906, 0.8244357580921962, 0.051965138551161236, 2.50003171557572, 10.540262999988045, 121.00500185292593),
    ('hgb_mae_full_missing_bad_weight', 124.28068281193619, 634.024191378109, 0.8240174391465847, 0.05209826762415026, 2.89753167120616, 7.724300600013521, 122.154870986916),
    ('extra_trees_full_abs_weight', 164.83665843288645, 653.2909875768854, 0.8128135134331511, 0.06913465718021028, 33.337631242882345, 15.941916900010256, 161.99864581334077),
    ('ridge_log_full_abs_weight', 185.25354414645946, 659.8868821188819, 0.8093555995498928, 0.07759541539388039, 20.48427824107394, 4.59229790000245, 169.55897585399043),
    ('distance_linear', 194.3382436785733, 650.2370527860477, 0.8148955026321228, 0.08143819554236639, 4.917734291341403, 0.07372709998162463, 192.7741904419588),
    ('equipment_median_rpm', 227.68507359380322, 668.0857615159732, 0.80453053729884, 0.09546815308701204, 11.432546317548786, 0.03300259999377886, 231.30495570141687),
    ('global_median', 1140.510944071281, 1553.9751406272512, -0.05694560542020492, 0.47794312528128435, 16.491405875424736, 0.00480000000243308, 1146.7937069853701),
]

SCENARIO_RANKINGS = [
    ('december_hgb_mae_abs_weight', 115.88734402615304, 114.83187813531208),
    ('december_extra_trees_abs_weight', 175.17881413093372, 140.85895198244629),
    ('december_ridge_log_abs_weight', 212.8916513381781, 275.5723631758285),
    ('december_equipment_median_rpm', 227.68507359380322, 229.09657316845033),
]
